"""Main text of web pages by consensus host paths.

Each page scores its containers: the text that stands in them outside links and outside page furniture (elements, roles, names
of classes and ids). Containers are known by generalised paths of tags and classes (numbers in classes are left out). In Spark,
the pages of a host are compared: a container whose text recurs on different pages is no article, one whose text differs is.
A page's vote is the least container that holds all of its differing text, but never less than a whole `article`; votes are counted for each host,
and every page is extracted again by its host's winning path. A page that has no such container is extracted by its own vote.
A page's only `article` (or `main`) that holds at least half of its text outweighs the containers beside it, unless a headline or bare text stands there.

Names are evidence of different weight. Furniture words count wherever they stand in a name; words that articles use, too (social, register, share), only where the
whole name has nothing but such and neutral words, not on a paragraph of an article, and not on an element that holds half of the page.
"""

from __future__ import annotations

import hashlib
import html as html_entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved, ship

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = frozenset(("script", "style", "textarea", "title", "template", "iframe", "svg", "annotation", "select", "canvas"))
_VOID = frozenset(("br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"))
_BLOCK = frozenset(
    "html body div section article main nav header footer aside form ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address fieldset details summary dialog menu search hgroup center button label noscript".split()
)
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption pre figcaption summary thead tbody tfoot".split())  # never a container
_CLOSES = {  # an opening tag ends an open element of these kinds
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
}
# Elements, roles and name words of page furniture.
_FURNITURE = frozenset("nav footer aside form menu dialog button label fieldset search".split())
_OUTSIDE = frozenset("header noscript".split())  # furniture unless inside an article or main element
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs masthead topbar footer sidebar sidebars cookie cookies consent gdpr popup newsletter login signup paywall pagination pager".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus".split())
_LOOSE = frozenset(
    "banner header aside rail widget widgets notice notices alert modal overlay subscribe subscription register share sharing social related "
    "recommended recommendations reply replies respond toc skip".split()
)
_NEUTRAL = frozenset(
    "site page post posts entry article articles story stories main content area section block box item items list links link buttons button bar icons icon wrapper wrap container "
    "inner outer top bottom left right col column row first last panel group set form title heading js the my to us on and more global".split()
)
_NAMES = frozenset("hidden is-hidden visually-hidden visuallyhidden".split())  # whole names: as words they stand in layout names, too
_HAS = re.compile(r"(?:has|with|without|no)[-_]|.*layout", re.I)  # such names tell what stands beside or inside
_WHOLE = frozenset("html body main article".split())  # elements that hold the page or its text, whatever their names
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
TEXT, HARD, NAMED, LOOSE, COMMENT = range(5)  # what an element is taken for
DEPTH = 100  # elements further down belong to the container at this depth
RECURS = 3  # different pages on which a container's text must be known before it counts as recurring


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html_entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def _kind(tag: str, attributes: dict[str, str], inside: bool) -> int:
    """What an element's tag, attributes and names take it for; ``inside``: it stands in an article or main element."""
    if tag in _FURNITURE or (tag in _OUTSIDE and not inside) or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return HARD
    if not attributes:
        return TEXT
    if attributes.get("role", "").lower() in _ROLES or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return HARD
    if tag in _WHOLE:
        return TEXT
    kind = TEXT
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        if name.lower() in _NAMES:
            return NAMED
        if _HAS.match(name):
            continue
        words = {w.lower() for w in _SPLIT.split(name) if len(w) > 1}
        if words & _COMMENTS:
            return COMMENT
        if words & _WORDS:
            kind = NAMED
        elif kind == TEXT and words & _LOOSE and words <= _LOOSE | _NEUTRAL and not (inside and (tag in _LEAF or tag == "header")):
            kind = LOOSE
    return kind


def _label(tag: str, attributes: dict[str, str]) -> str:
    """Tag and classes; digits, and classes that have nothing else, are left out."""
    classes = sorted({c for x in attributes.get("class", "").split() if (c := re.sub(r"[\d_-]*\d[\d_-]*", "", x).strip("-_.").replace(">", ""))})
    return ".".join([tag, *classes])


class Element:
    __slots__ = ("box", "depth", "furniture", "inside", "kind", "parent", "path", "score", "size", "tag")

    def __init__(self, tag: str, path: str, kind: int, parent: Element | None, leaf: bool = False):
        self.tag, self.path, self.kind, self.parent = tag, path, kind, parent
        self.box = parent.box if leaf else self  # the least container
        self.depth = parent.depth + 1 if parent else 0
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.score, self.size, self.furniture = 0, 0, False


Block = tuple[Element, str, int]  # element, text, characters outside links


def _settle(elements: list[Element], blocks: list[Block]) -> None:
    """Decide which elements are furniture, and sum sizes (of all but hard furniture) and scores (of no furniture) upwards."""
    for e in elements:
        e.furniture = e.kind == HARD or (e.parent is not None and e.parent.furniture)
    for e, text, _ in blocks:
        if not e.furniture:
            e.size += len(text)
    for e in reversed(elements[1:]):
        e.parent.size += e.size
    total = elements[0].size
    for believed in ((HARD, NAMED, LOOSE, COMMENT), (HARD, COMMENT), (HARD,)):  # names that leave no text are not believed
        for e in elements:
            said = e.kind in believed and not (e.kind == LOOSE and 2 * e.size >= total)
            e.furniture = said or (e.parent is not None and e.parent.furniture)
        if any(not e.furniture for e, _, _ in blocks):
            break
    for e, _, gain in blocks:
        if not e.furniture:
            e.score += gain
    for e in reversed(elements[1:]):
        e.parent.score += e.score


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """Elements (the root first, parents before children) and blocks of a page, in page order."""
    root = Element("", "", TEXT, None)
    elements = [root]
    here, blocks, buffer, linked = root, [], [], 0
    in_link = False

    def close() -> None:
        nonlocal linked
        text = " ".join(html_entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            blocks.append((here, text, max(0, len(text) - 2 * linked)))
        linked = 0

    def text_found(text: str) -> None:
        nonlocal linked
        buffer.append(text)
        if in_link:
            linked += len(text)

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text_found(page[at:])
            break
        if m.start() > at:
            text_found(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue  # comment, doctype or instruction
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = False
            elif tag in _BLOCK:
                e = here
                while e is not root and e.tag != tag:
                    e = e.parent
                if e is not root:
                    close()
                    here = e.parent
            continue
        if tag in _RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in ("br", "hr"):
            buffer.append(" ")
        if tag in _VOID:
            continue
        if tag == "a":
            in_link = True
        if tag not in _BLOCK:
            continue
        close()
        in_link = False
        ends = _CLOSES.get(tag, ("p", *(("h1", "h2", "h3", "h4", "h5", "h6") if tag in _LEAF else ())))
        while here.tag in ends:
            here = here.parent
        attributes = _attributes(m[3]) if m[3].strip(" /") else {}
        leaf = tag in _LEAF or here.box is not here or here.depth >= DEPTH
        path = here.path if leaf else f"{here.path}{_label(tag, attributes)}>"
        here = Element(tag, path, _kind(tag, attributes, here.inside), here, leaf)
        elements.append(here)
    close()
    _settle(elements, blocks)
    return elements, [b for b in blocks if not b[0].furniture]


def lead(elements: list[Element], blocks: list[Block]) -> set[Element] | None:
    """The page's only article (else main) element with all below it, if it holds half of the text and neither a headline nor bare text stands beside it."""
    for tag in ("article", "main"):
        one = next((e for e in elements if e.tag == tag and e.score), None)
        if one is None or 2 * one.score < elements[0].score:
            continue
        under, above, e = {one}, set(), one.parent
        while e is not None:
            above.add(e)
            e = e.parent
        for e in elements:  # parents come before children
            if e.parent in under:
                under.add(e)
        beside = [e for e, _, _ in blocks if e not in under]
        if any(e.tag == tag and e.score and e not in under for e in elements) or any(e.tag == "h1" or e.box in above for e in beside):
            continue
        return under
    return None


def sections(elements: list[Element], blocks: list[Block]) -> dict[str, tuple[str, int, bool]]:
    """Text, score of every container path's own blocks, and whether the page's lead stands elsewhere."""
    under, texts, scores, beside = lead(elements, blocks), {}, {}, {}
    for e, text, gain in blocks:
        texts.setdefault(e.path, []).append(text)
        scores[e.path] = scores.get(e.path, 0) + gain
        beside[e.path] = beside.get(e.path, True) and under is not None and e not in under
    return {p: ("\n".join(x), scores[p], beside[p]) for p, x in texts.items()}


def common(paths: list[str]) -> str:
    """Least container of some paths; an article is not cut."""
    if not paths:
        return ""
    low, high, out = min(paths).split(">")[:-1], max(paths).split(">")[:-1], ""
    for a, b in zip(low, high, strict=False):
        if a != b:
            break
        out += a + ">"
        if a.split(".")[0] == "article":
            break
    return out


def extract(page: str, path: str | None, constant: list[str] | None = None) -> str:
    """Text of the containers under this path; by the page's own vote if it has none with text.

    ``constant``: paths outside articles whose text is the same all over the host; they are left out unless half of the text stands there.
    """
    elements, blocks = parse(page)
    parts = sections(elements, blocks)
    own = common([p for p, (_, score, beside) in parts.items() if score and not beside])
    wanted = path if path and any(p.startswith(path) for p in parts) else own
    if own.startswith(wanted) and lead(elements, blocks) is not None:
        wanted = own
    found = [b for b in blocks if b[0].path.startswith(wanted)]
    kept = [b for b in found if b[0].path not in constant] if constant else found
    if 2 * sum(b[2] for b in kept) < sum(b[2] for b in found):
        kept = found
    return "\n".join(text for _, text, _ in kept)


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def main_text(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html; other columns are not read).

    Returns page_id, url, text (blocks joined by line ends; empty if none), n_chars, host, path (the host's winning path; null
    without a host). A null html counts as empty. A page without a host (null or odd url) goes by its own vote. Pages of a host with the same
    blocks vote once; a page whose differing text has no container in common does not vote. A container's text recurs if RECURS different pages of the host have the container and its texts are at most half as many as they; containers
    outside articles with one text on at least half of the host's pages are left out. Equal votes
    go to the greater score, then to the path first in code-point order. Repeated rows come out each time. Pages of any
    length are parsed whole. An empty table gives no rows.
    """
    spark = pages.sparkSession
    ship(spark)
    host = F.regexp_extract(F.lower(F.coalesce(F.col("url").cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), F.when(host != "", host).alias("host"))

    def sectioned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts = sections(*parse(page.as_py()))
                look = _digest(repr(sorted(parts.items())))
                out += [(host, look, p, _digest(text), score, beside) for p, (text, score, beside) in parts.items()]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["host", "page", "path", "content", "score", "beside"])

    salts = 16  # a hot host's pages and sections spread over these
    salted_by = lambda *c: F.pmod(F.xxhash64(*c), F.lit(salts)).cast("int")
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    parts = rows.where("host is not null").select("host", "html").mapInArrow(sectioned, "host string, page long, path string, content long, score long, beside boolean")
    parts = saved(parts.dropDuplicates(["host", "page", "path"]), "page-sections")
    kinds = parts.groupBy("host", "path", "content").agg(F.count(F.lit(1)).alias("n")).groupBy("host", "path").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    recurring = saved(kinds.where((F.col("n") >= RECURS) & (2 * F.col("texts") <= F.col("n"))), "page-recurring")
    seen = parts.withColumn("salt", salted_by("page")).join(recurring.select("host", "path", F.lit(True).alias("recurs"), every_salt.alias("salt")), ["host", "path", "salt"], "left")
    differs = F.col("recurs").isNull() & ~F.col("beside") & (F.col("score") > 0)
    # the least container of all sections is that of the first and the last path in order
    voted = seen.groupBy("host", "page").agg(F.min(F.when(differs, F.col("path"))).alias("low"), F.max(F.when(differs, F.col("path"))).alias("high"), F.sum(F.when(differs, F.col("score"))).alias("score"))
    steps = F.slice(F.split("low", ">"), F.lit(1), F.size(F.split("low", ">")) - 1)
    same = F.filter(F.transform(steps, lambda x, i: F.struct(i.alias("i"), (x == F.element_at(F.split("high", ">"), (i + 1).cast("int"))).alias("same"))), lambda x: ~F.coalesce(x["same"], F.lit(False)))
    least = F.when(F.size(same) > 0, F.slice(steps, F.lit(1), same[0]["i"].cast("int"))).otherwise(steps)
    whole = F.filter(F.transform(least, lambda x, i: F.when(F.split(x, "\\.")[0] == "article", i + 1)), lambda x: x.isNotNull())
    vote = F.when(F.size(whole) > 0, F.slice(least, F.lit(1), whole[0].cast("int"))).otherwise(least)
    voted = saved(voted.select("host", "score", F.when(F.size(vote) > 0, F.concat(F.array_join(vote, ">"), F.lit(">"))).alias("path")), "page-votes")
    votes = voted.where("path is not null").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    winner = F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), F.col("path").alias("path")))["path"]
    per_host = voted.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    # each such path stands on half of the host's pages, so a host has at most twice as many as a page has sections
    constant = recurring.join(per_host, "host").where((F.col("texts") == 1) & (2 * F.col("n") >= F.col("pages")) & ~F.concat(F.lit(">"), "path").rlike(r">article[.>]"))
    constant = constant.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("constant"))
    winners = saved(votes.groupBy("host").agg(winner.alias("path")).join(constant, "host", "left"), "host-paths").withColumn("salt", every_salt)
    salted = rows.withColumn("salt", salted_by("page_id", "url"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py(), path.as_py(), c.as_py()) for p, path, c in zip(batch.column(2), batch.column(4), batch.column(5), strict=True)]
            cols = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column(3), pa.array([x and x.rstrip(">") for x in batch.column(4).to_pylist()], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars", "host", "path"])

    id_type = rows.schema["page_id"].dataType.simpleString()
    url_type = rows.schema["url"].dataType.simpleString()
    joined = salted.join(winners, ["host", "salt"], "left").select("page_id", "url", "html", "host", "path", "constant")
    return joined.mapInArrow(extracted, f"page_id {id_type}, url {url_type}, text string, n_chars long, host string, path string")
