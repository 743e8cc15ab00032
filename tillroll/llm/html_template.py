"""Main text of web pages by equivalence-class template deduction.

1. Every page becomes a stream of tokens: an element's *role* (the path of
   element names, classes and ids that leads to it) and each text block (its
   path and a hash of the text).
2. Over the distinct contents of a host's pages (copies count once), tokens
   with one occurrence vector form an equivalence class.  Vectors are compared
   by two sums of content hashes times counts, so they are built by a partially
   aggregated sum and never gathered.  A class needs several tokens, each once a
   page, on at least ``LEAST`` contents and half of the host's.
3. A class is valid when it is in order and nested on nearly all contents: its
   tokens follow one another in one order, and each stands in the same gap
   between the tokens of the host's largest class.  The valid classes are the
   template.  Their text blocks are constant; the slot is the element of theirs
   that holds the text that varies (an article element, else a main element,
   else one named like an article, else the deepest container with most of it).
   Constant text is struck only where the slot is a mere container: what belongs
   to the slot's own class there, headings apart.
4. Each page is read against its host's template: what the article's slot holds
   is extracted, except template text and parts that are menus, headers,
   footers, sidebars, notices, adverts, forms or comments by element, class, id
   or ARIA role (fixed lists, which decide beside the classes).  A class or id leaves out neither the article nor what
   encloses it; inside the article ids leave out nothing, and headings, paragraphs
   and elements in a sentence go by a whole class alone.  A page on which a class doesn't keep its order or without
   that slot, and pages of hosts without valid classes, are read by the same
   rules from their own tokens alone; so are pages with an article element where
   the slot is a mere container.

Defined cases: a null or empty html has no text; a null url is a host of its
own name, empty; broken markup is read as far as it goes (an unfinished tag at
the end is dropped, unclosed elements end with the one around them); pages that
repeat are read each, but make one content; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.arrow import pieces
from tillroll.llm.tables import written

#: A class belongs to the template when this share of the host's contents has it,
#: and that many of them: two pages with text in common may as well be copies.
SUPPORT, LEAST = 0.5, 3
#: A class is valid when it is in order and nested on this share of its contents.
VALID = 0.9
#: A container is the article's if this share of the varying text is in it.
MOST = 0.6
#: Text named like an article rivals a left-out name with this share of a page.
RIVAL = 0.1
#: Templates of at most this many rows are broadcast, more are joined.
BROADCAST_ROWS = 200_000
SALTS = 16

# Elements of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "svg", "textarea", "title", "iframe", "object", "math", "canvas")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q ruby s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
LEFT_OUT = frozenset("nav header footer aside form button select option dialog menu fieldset input".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
LEFT_OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menus"
    " breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets cookie cookies consent gdpr notice notices alert popup"
    " modal newsletter subscribe signup login share sharing social related recommended comment comments commentlist disqus respond"
    " replies reply pagination pager toc copyright skip".split()
)
#: On an element inside a sentence only these classes leave it out.
INLINE_OUT = frozenset("ad ads advert adverts advertisement adsense sponsor sponsored promo share sharing social".split())
#: Here a listed word counts only as a class of its own, never as part of one.
TEXT_ELEMENTS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figure figcaption table caption tr th td dl dt dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 dt th caption figcaption".split())
BLOCKS = frozenset(
    "address article aside base blockquote body caption center col colgroup dd details dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main meta nav ol optgroup p param pre search section source"
    " summary table tbody td tfoot th thead tr track ul".split()
) | LEFT_OUT
ARTICLE_NAMES = frozenset("article content post entry story main body text".split())
CONTAINERS = frozenset("article main section div td body".split())
CLOSES = {  # an element that opens ends an open one of these
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[a-zA-Z])[^<>]*\Z", re.DOTALL)
#: One attribute, or a quoted string that belongs to none.
_ATTRIBUTE = re.compile(r"\"[^\"]*\"|'[^']*'|([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-zA-Z][a-z]*|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE) for name in RAW}


@dataclass(eq=False)
class Element:
    tag: str
    role: str
    out: bool  # left out by its element, ARIA role or hidden attribute
    named: bool  # left out by its class or id
    classed: bool  # left out by its class alone
    names: frozenset
    at: int = 0  # place among the page's elements and blocks

    @property
    def left_out(self) -> bool:
        return self.out or self.named

    @property
    def kind(self) -> int:
        """0 article, 1 main, 2 named like one, 3 container, 4 other."""
        if self.tag not in CONTAINERS:
            return 4
        return 0 if self.tag == "article" else 1 if self.tag == "main" else 2 if self.names & ARTICLE_NAMES and self.tag != "body" else 3


@dataclass
class Block:
    path: tuple  # of elements
    text: str
    at: int = 0


@dataclass
class Page:
    elements: list = field(default_factory=list)
    blocks: list = field(default_factory=list)


_PATH_MARKS = str.maketrans("/#", "__")  # what parts a path and its text


def _attributes(raw: str) -> dict[str, str]:
    out = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), a or b or c)
    return out


def _words_of(label: str) -> frozenset:
    return frozenset(n.lower() for n in _NAME.findall(label))


def _listed(label: str, words: frozenset) -> bool:
    """Whether a whole class is one of the words."""
    return any(c.lower() in words for c in label.split())


def _element(tag: str, raw: str, above: str, inside: bool = False) -> Element:
    """``inside``: below an article or main element, where ids name sections."""
    attributes = _attributes(raw) if raw else {}
    label = " ".join(attributes.get(k, "") for k in ("class", "id"))
    names = _words_of(label)
    out = tag in LEFT_OUT or attributes.get("role", "").lower() in LEFT_OUT_ROLES or "hidden" in attributes
    # a main element or an article named like one has other words by the way
    may = tag != "main" and not (tag == "article" and names & ARTICLE_NAMES)
    if tag in TEXT_ELEMENTS:
        classed = named = _listed(attributes.get("class", ""), LEFT_OUT_NAMES)
    else:
        classed = may and bool(_words_of(attributes.get("class", "")) & LEFT_OUT_NAMES)
        named = classed if inside else may and bool(names & LEFT_OUT_NAMES)
    if tag in ("html", "body"):
        out = named = classed = False
    marks = "".join("." + n for n in sorted({re.sub(r"\d+", "0", x).translate(_PATH_MARKS) for x in label.split()}))
    return Element(tag, f"{above}/{tag}{marks}", out, named, classed, names)


def read_page(source: str | None) -> Page:
    """Elements and text blocks of a page, in order."""
    page, stack, parts = Page(), [], []
    source = source or ""
    muted: list = []  # an element in a sentence that is left out: [its name, how many are open, where its text begins]

    def flush() -> None:
        if muted:  # it ends with the block around it
            del parts[muted[2] :]
            muted.clear()
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            page.blocks.append(Block(tuple(stack), text, len(page.elements) + len(page.blocks)))

    at = 0
    while at < len(source):
        m = _TAG.search(source, at)
        if m is None:
            parts.append(source[at:])
            break
        parts.append(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            if m[3].rstrip().endswith("/"):
                continue
            end = _RAW_END[tag].search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in INLINE or (tag not in BLOCKS and _in_sentence(tag, closing, stack, parts)):
            if tag == "br":
                parts.append(" ")
            elif muted and tag == muted[0]:
                muted[1] += -1 if closing else 1
                if not muted[1]:
                    del parts[muted[2] :]
                    muted.clear()
            elif not muted and not closing and tag not in VOID and m[3] and _listed(_attributes(m[3]).get("class", ""), INLINE_OUT):
                muted += [tag, 1, len(parts)]
            continue
        flush()
        if closing:
            at_open = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if at_open is not None:
                del stack[at_open:]
            continue
        if stack and stack[-1].tag == "p":
            stack.pop()
        while stack and stack[-1].tag in CLOSES.get(tag, ()):
            stack.pop()
        element = _element(tag, m[3], stack[-1].role if stack else "", any(e.kind <= 1 for e in stack))
        element.at = len(page.elements) + len(page.blocks)
        page.elements.append(element)
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(element)
    flush()
    if any(e.named for e in page.elements):
        _unmark(page)
    return page


def _in_sentence(tag: str, closing: bool, stack: list, parts: list) -> bool:
    """An element that HTML doesn't know is part of a sentence where text stands
    before it or a paragraph is open, and a container elsewhere."""
    if closing:
        return all(e.tag != tag for e in stack)
    return bool(stack and stack[-1].tag in TEXT_ELEMENTS | {"li"}) or any(p.strip() for p in parts)


def _unmark(page: Page) -> None:
    """A name doesn't leave out what is or encloses the article: an element with
    most of the page's text, unless that text is beside or below an article of
    its own, as long comments are."""
    read = [b for b in page.blocks if not any(e.out for e in b.path)]
    total = sum(len(b.text) for b in read)
    inside: dict[int, int] = {}
    above: dict[int, tuple] = {}  # element -> path to it, of elements with text
    for b in read:
        for i, e in enumerate(b.path):
            inside[e.at] = inside.get(e.at, 0) + len(b.text)
            above.setdefault(e.at, b.path[: i + 1])

    def clean(s: Element, e: Element) -> int:
        """Characters in ``s`` that no name leaves out, none of them in ``e``."""
        return sum(len(b.text) for b in read if s in b.path and e not in b.path and not any(x.named for x in b.path))

    for e in page.elements:
        if not e.named or 2 * inside.get(e.at, 0) < max(1, total) or any(x.named for x in above[e.at][:-1]):
            continue
        articles = [p for p in above.values() if p[-1].kind <= 2 and not any(x.named and x is not e for x in p)]
        if not any(e in p and p[-1].kind <= 1 and 2 * inside[p[-1].at] >= total for p in articles):
            rivals = [p[-1] for p in articles if e not in p]
            e.named = e.named and any(clean(s, e) >= (RIVAL * total if s.kind == 2 or s in above[e.at] else 1) for s in rivals)
        else:
            e.named = False
        e.classed = e.classed and e.named


def _left_out(block: Block, slot: str | None = None) -> bool:
    """Names on the way to the slot leave nothing out of it, nor do ids inside."""
    start = next((i + 1 for i, e in enumerate(block.path) if e.role == slot), 0)
    if any(e.out for e in block.path):
        return True
    return any(e.classed if start else e.named for e in block.path[start:])


def text_token(block: Block) -> str:
    said = hashlib.blake2b(block.text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
    return f"{block.path[-1].role if block.path else ''}#{said}"


def page_tokens(page: Page) -> dict[str, list]:
    """token -> [occurrences, first place, characters of candidate text inside,
    kind: 0 article, 1 main, 2 named like one, 3 container, 4 other, 5 text]."""
    out: dict[str, list] = {}
    for e in page.elements:
        out.setdefault(e.role, [0, e.at, 0, 4 if e.left_out else e.kind])[0] += 1
    for b in page.blocks:
        token = out.setdefault(text_token(b), [0, b.at, 0, 5])
        token[0] += 1
        if not _left_out(b):
            token[2] += len(b.text)
            for role in {e.role for e in b.path}:
                out[role][2] += len(b.text)
    return out


def article_role(candidates: list[tuple[str, int, int]]) -> str | None:
    """The article's slot among ``(role, kind, characters)``."""
    total = max((c for _, _, c in candidates), default=0)
    if not total:
        return None
    for kind in (0, 1, 2):
        of_kind = sorted((r.count("/"), r) for r, k, c in candidates if k == kind and c >= MOST * total)
        if of_kind:
            return of_kind[0][1]
    deep = sorted((-r.count("/"), r) for r, k, c in candidates if k <= 3 and c >= MOST * total)
    return deep[0][1] if deep else None


@dataclass
class Template:
    """What a host's pages have in common."""

    classes: list  # tokens of the valid classes, each in its order
    texts: frozenset  # constant text of the article's slot
    article: str | None
    kind: int = 4  # of the article's slot


def in_order(order: list, places: dict) -> bool:
    at = [places[t] for t in order if t in places]
    return at == sorted(at)


def fits(page: Page, template: Template) -> bool:
    """Whether the page has the slot and keeps the order of the classes."""
    tokens = page_tokens(page)
    if template.article not in tokens or (template.kind == 3 and any(v[3] <= 1 and v[2] for v in tokens.values())):
        return False
    places = {t: v[1] for t, v in tokens.items()}
    return all(in_order(c, places) for c in template.classes)


def main_text(source: str | None, template: Template | None = None) -> str:
    """The article's blocks, joined by empty lines."""
    page = read_page(source)
    if template is None or not fits(page, template):
        tokens = page_tokens(page)
        candidates = [(role, v[3], v[2]) for role, v in tokens.items() if v[3] <= 3]
        template = Template([], frozenset(), article_role(candidates))
    if template.article is None:
        kept = [b for b in page.blocks if not _left_out(b)]
    else:
        kept = [b for b in page.blocks if any(e.role == template.article for e in b.path) and not _left_out(b, template.article)]
    if template.texts:
        kept = [b for b in kept if text_token(b) not in template.texts or _heading(b)] or kept
    return "\n\n".join(b.text for b in kept)


def _heading(block: Block) -> bool:
    return any(e.tag in HEADINGS for e in block.path)


# ------------------------------------------------------------------ Spark

TOKEN = pa.struct([("token", pa.string()), *((k, pa.int64()) for k in ("n", "place", "chars", "kind"))])
SEEN = "host string, content binary, page long, tokens array<struct<token: string, n: long, place: long, chars: long, kind: long>>"


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))


def page_contents(pages: DataFrame) -> DataFrame:
    """The tokens of each host's pages, once for all pages that read the same;
    pages without tokens are left out."""

    def contents(batches):
        for batch in pieces(batches, 1):
            hosts, keys, numbers, flat, ends = [], [], [], [], [0]
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = page_tokens(read_page(source))
                if tokens:
                    said = "\0".join(f"{t}\0{v[0]} {v[1]}" for t, v in tokens.items())
                    key = hashlib.blake2b(said.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    hosts.append(host)
                    keys.append(key)
                    numbers.append(int.from_bytes(key[:8], "big", signed=True))
                    flat += [(t, *v) for t, v in tokens.items()]
                    ends.append(len(flat))
            columns = list(zip(*flat, strict=True)) or [()] * 5
            listed = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, TOKEN, strict=True)], fields=list(TOKEN))
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), listed)
            columns = [pa.array(hosts, pa.string()), pa.array(keys, pa.binary()), pa.array(numbers, pa.int64()), listed]
            yield pa.RecordBatch.from_arrays(columns, ["host", "content", "page", "tokens"])

    found = pages.select(_host(F.col("url")).alias("host"), "html").mapInArrow(contents, SEEN)
    return found.dropDuplicates(["host", "content"])


def classes_of(seen: DataFrame) -> DataFrame:
    """``host, classes``: the tokens of every class, the host's largest first,
    each class by the place of its tokens."""
    found = seen.select("host", "page", F.explode("tokens").alias("t")).select("host", "page", "t.*")
    # the occurrence vector's two fingerprints: sums of 31-bit page hashes times counts
    part = lambda shift: F.sum(F.shiftrightunsigned("page", shift).bitwiseAND(F.lit((1 << 31) - 1)) * F.col("n"))
    vectors = found.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("pages"), F.max("n").alias("most"), part(0).alias("va"), part(31).alias("vb"),
        F.avg("place").alias("place"), F.sum("chars").alias("chars"), F.min("kind").alias("kind"),
    )
    sizes = seen.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    kept = vectors.where((F.col("pages") >= LEAST) & (F.col("most") == 1)).join(sizes, "host").where(F.col("pages") >= F.col("of") * SUPPORT)
    entry = F.struct("place", "token", "kind", "chars")
    classes = kept.groupBy("host", "pages", "va", "vb").agg(F.sort_array(F.collect_list(entry)).alias("rows")).where(F.size("rows") > 1)
    entry = F.struct((-F.col("pages")).alias("_p"), (-F.size("rows")).alias("_s"), "va", "vb", "rows")
    return classes.groupBy("host").agg(F.sort_array(F.collect_list(entry)).alias("classes")).select("host", F.col("classes.rows").alias("classes"))


def nesting(order: list, root: list, places: dict) -> str | None:
    """In which gaps of the largest class a class's tokens stand on a page; ``-``
    out of order, None where the page lacks the class."""
    if not all(t in places for t in order):
        return None
    if not in_order(order, places):
        return "-"
    edges = sorted(places[t] for t in root if t in places)
    gaps = [] if order == root else [bisect.bisect(edges, places[t]) for t in order]
    return hashlib.blake2b(str(gaps).encode(), digest_size=8).hexdigest()


def _beside(rows: DataFrame, known: DataFrame, salt: str) -> DataFrame:
    """Rows with the classes of their host."""
    n = known.select(F.sum(F.expr("aggregate(classes, 0, (n, c) -> n + size(c))"))).first()[0] or 0
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(known), "host", "left")
    # a host with very many pages is spread over the salts
    salts = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(salts, ["host", "salt"], "left")


def templates(pages: DataFrame) -> DataFrame:
    """``host, classes(arrays of place, token, kind, chars)``: the valid classes
    of every host."""
    seen = written(page_contents(pages), "page-contents")
    known = written(classes_of(seen), "classes")

    def shapes(batches):
        made: dict[str, list] = {}
        for batch in batches:
            hosts, numbers, said = [], [], []
            for host, tokens, places, classes in zip(*(batch.column(i) for i in range(4)), strict=True):
                host = host.as_py()
                if host not in made:
                    if len(made) > 10_000:
                        made.clear()
                    made[host] = [[r["token"] for r in c] for c in classes.as_py() or []]
                if made[host]:
                    at = dict(zip(tokens.as_py(), places.as_py(), strict=True))
                    for i, order in enumerate(made[host]):
                        shape = nesting(order, made[host][0], at)
                        if shape:
                            hosts.append(host)
                            numbers.append(i)
                            said.append(shape)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(numbers, pa.int64()), pa.array(said, pa.string())], ["host", "class", "shape"])

    held = _beside(seen, known, "content").where("classes is not null").select("host", "tokens.token", "tokens.place", "classes")
    shaped = held.mapInArrow(shapes, "host string, class long, shape string").groupBy("host", "class", "shape").agg(F.count(F.lit(1)).alias("n"))
    most = F.max(F.when(F.col("shape") != "-", F.col("n")))
    valid = shaped.groupBy("host", "class").agg((most >= VALID * F.sum("n")).alias("valid")).where("valid")
    numbered = known.select("host", F.posexplode("classes").alias("class", "rows"))
    kept = numbered.join(valid.select("host", "class"), ["host", "class"])
    listed = F.sort_array(F.collect_list(F.struct("class", "rows"))).alias("classes")
    return kept.groupBy("host").agg(listed).select("host", F.col("classes.rows").alias("classes"))


def _template(classes: list | None) -> Template | None:
    if not classes:
        return None
    constant = {r["token"]: r["chars"] for c in classes for r in c if r["kind"] == 5}
    within = lambda role, texts: sum(n for t, n in texts.items() if t.startswith((f"{role}/", f"{role}#")))
    whole = {r["token"]: (r["kind"], r["chars"]) for c in classes for r in c if r["kind"] <= 3}
    varying = [(t, kind, n - within(t, constant)) for t, (kind, n) in whole.items()]
    total, left = max((n for _, n in whole.values()), default=0), max((n for _, _, n in varying), default=0)
    # where next to nothing varies, what is common is the article
    article = article_role(varying if left >= RIVAL * total else [(t, kind, n) for t, (kind, n) in whole.items()])
    if not article:
        return None
    own = next(c for c in classes if any(r["token"] == article for r in c))
    inside = {r["token"]: r["chars"] for r in own if r["kind"] == 5 and within(article, {r["token"]: 1})}
    if whole[article][0] <= 2:  # what an article says on all pages is its own: recipes share their headings
        inside = {}
    if 2 * sum(inside.values()) > whole[article][1]:  # near copies again
        inside = {}
    orders = [[r["token"] for r in c] for c in classes]
    return Template(orders, frozenset(inside), article, whole[article][0])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    known = written(templates(pages), "templates")
    own = pages.withColumn("host", _host(F.col("url")))
    joined = _beside(own, known, "page_id")

    def extract(batches):
        made: dict[str, Template | None] = {}
        for batch in pieces(batches, 3):
            texts = []
            for host, source, classes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if host not in made:
                    if len(made) > 10_000:
                        made.clear()
                    made[host] = _template(classes.as_py())
                texts.append(main_text(source, made[host]))
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    needed = joined.select("page_id", "url", "host", "html", "classes")
    return needed.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
