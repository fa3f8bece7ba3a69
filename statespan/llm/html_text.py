"""HTML extraction by equivalence-class template deduction.

Pages become tokens: the open elements on the way to a block (its path) and the
block's text on that path, told apart by how often it stood before. Over the pages of a host each token has an occurrence
vector (how often it stands in each page); tokens with equal vectors form an
equivalence class, and classes of enough tokens and pages are valid. A class whose paths
lie inside another's is nested in it, and a text is the template's own if its class is
valid and its block stands in an element of a valid class, its own or the one it is nested in.
What is left are the slots. The article is what the page marks as such (article, main),
whole, or else all slots.

Elements that are menus, headers, footers, sidebars, notices, adverts, forms, scripts or
comments by their kind, role or class names are no part of the article. Outside of a
marked article any part of a name counts (``related-work`` holds ``related``); inside,
only names that say nothing else (``comment-list``, ``ad``), so an article loses no
section over a name.

Vectors are never gathered: a class is known by a digest that adds up over its
pages, so a host of any size is only grouped sums. Pages whose blocks outside of menus,
adverts and so on are equal count as one page, so that copies of an article do not make
it part of the template.

Defined cases: a null html gives an empty text; a null or odd url is host "";
unclosed elements end with their parents; of equal texts on one path the first of each
page are one token, the second another, and so on; a text on fewer than MIN_SUPPORT
different pages of a host is never its template's; pages are read whole, however long;
repeated rows each give a row; an empty table gives none; extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, saved, small_batches, table

#: A valid class has so many tokens, on so many different pages and this share of the host's.
MIN_TOKENS = 3
MIN_SUPPORT = 3
MIN_SHARE = 0.5

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+))""")
_HIDDEN = re.compile(r"\bhidden\b")
_NAME = re.compile(r"[^a-z0-9]+")
# Element names of HTML, and names that sites use for what isn't an article.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder mstyle mspace semantics".split())
_RAW = frozenset("script style textarea title noscript iframe noframes xmp template".split())
_NEVER = frozenset("head script style noscript template iframe object svg canvas select option button nav footer aside form dialog menu audio video map textarea title".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
_ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion".split())
_AROUND = frozenset("menu nav navbar navigation breadcrumb breadcrumbs sidebar side footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search social share sharing related recommended widget toolbar pagination pager copyright legal skip hidden".split())
_COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
# Names that say what an element is even inside an article, and words that may stand beside them.
_INSIDE = _ADVERTS | _COMMENTS - frozenset("reply respond".split()) | frozenset("menu nav navbar navigation breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices popup newsletter subscribe related recommended toolbar pagination pager".split())
_BESIDE = frozenset("area articles bar block bottom box container content feed form inner item items left links list main outer page post posts reader readers right section site slot stories stream thread threads top unit user users widget wrap wrapper".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table select body article section div main aside nav header footer form".split())


_kinds: dict[tuple[str, str, bool], tuple[str, bool]] = {}
_paths: dict[tuple[str, ...], tuple[int, ...]] = {}
_KEEP = 4096


def _remembered(known: dict, key: tuple, make):
    """``make(*key)`` out of a small store that starts anew when full."""
    if key not in known:
        if len(known) >= _KEEP:
            known.clear()
        known[key] = make(*key)
    return known[key]


def _says(names: str) -> bool:
    """Whether one of an element's names says that it is no part of an article and nothing else."""
    for name in names.lower().split():
        parts = {x for x in _NAME.split(name) if x and not x.isdigit()}
        if parts & _INSIDE and parts <= _INSIDE | _BESIDE:
            return True
    return False


def _kind(tag: str, raw: str, in_article: bool) -> tuple[str, bool]:
    """The element's label in paths, and whether it is no part of an article."""
    attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}
    label = attributes.get("class", "") or attributes.get("id", "")
    label = f"{tag}.{label}" if label else tag
    if tag in ("html", "body", "main"):
        return label, False
    called = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    names = set(_NAME.split(called.lower())) if attributes else set()
    if tag == "article":
        return label, bool(names & _COMMENTS)
    junk = tag in _NEVER or (tag == "header" and not in_article)
    if attributes:
        junk = junk or (_says(called) if in_article else bool(names & (_ADVERTS | _AROUND | _COMMENTS)) or "header" in names)
        junk = junk or attributes.get("role", "").lower() in _ROLES or attributes.get("aria-hidden") == "true"
        junk = junk or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    if not junk and _HIDDEN.search(_ATTRIBUTE.sub("", raw)):
        junk = True
    return label, junk


def blocks(page: str) -> list[tuple[tuple[str, ...], str, bool, bool]]:
    """(path, text, is junk, is in an article) of each block of text, in page order."""
    out: list = []
    stack: list[tuple[str, str, bool, bool]] = []  # tag, label, junk, article
    text: list[str] = []

    def flush():
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                _, _, junk, article = stack[-1] if stack else ("", "", False, False)
                out.append((tuple(s[1] for s in stack if s[0] not in _INLINE), joined, junk, article))

    def leave(k: int):
        flush()
        del stack[k:]

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        piece = page[at: m.start() if m else len(page)]
        if piece:
            text.append(entities.unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in _INLINE:
                        if any(s[0] not in _INLINE for s in stack[k:]):
                            break  # misnested: the block's own end closes it
                        if stack[k][2] and not (k and stack[k - 1][2]):
                            flush()
                        del stack[k:]
                    else:
                        leave(k)
                    break
            else:
                if tag not in _INLINE:
                    flush()
            continue
        if tag in _VOID:
            if tag == "br":
                text.append(" ")
            elif tag not in _INLINE:
                flush()
            continue
        _, _, junk, article = stack[-1] if stack else ("", "", False, False)
        if tag not in _INLINE:
            flush()
            closes = _CLOSED_BY.get(tag, {"p"})
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    leave(k)
                    break
                if stack[k][0] in _SCOPES:
                    break
            _, _, junk, article = stack[-1] if stack else ("", "", False, False)
        label, is_junk = _remembered(_kinds, (tag, m[3], article), _kind)
        if is_junk and not junk:
            flush()
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append((tag, label, junk or is_junk, article or tag in ("article", "main")))
    flush()
    return out


def _path_tokens(*path: str) -> tuple[int, ...]:
    """The token of each beginning of a path."""
    return tuple(_token("/".join(path[:k])) for k in range(1, len(path) + 1))


def _token(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode(), digest_size=8).digest(), "little", signed=True)


def _text_tokens(found: list) -> list[int]:
    """The token of each (path, text, ...): the first, second and so on of equal ones differ."""
    before: dict[tuple, int] = {}
    out = []
    for path, text, *_ in found:
        k = before[path, text] = before.get((path, text), -1) + 1
        out.append(_token("/".join(path), text, *([str(k)] if k else [])))
    return out


def _tokens(batches):
    """(host, page digest, token, path token it lies in, is text, n) of each page."""
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            found = blocks(page or "")
            digest = _token(*(x for path, text, junk, _ in found if not junk for x in ("/".join(path), text)))
            seen: dict[tuple[int, int, bool], int] = {}
            texts = iter(_text_tokens([x for x in found if not x[2]]))
            for path, _, junk, _ in found:
                parent, above = 0, 0
                for depth, here in enumerate(_remembered(_paths, path, _path_tokens), 1):
                    leaf = depth == len(path)
                    seen[here, parent, False] = seen.get((here, parent, False), 0) + 1 if leaf else max(1, seen.get((here, parent, False), 0))
                    parent, above = here, parent
                if not junk:  # the block itself may stand any number of times: what holds it counts
                    seen[next(texts), above or parent, True] = 1
            for (token, parent, is_text), n in seen.items():
                for c, v in zip(columns, (host, digest, token, parent, is_text, n)):
                    c.append(v)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "page", "token", "parent", "is_text", "n"])


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def template_tokens(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The valid classes of each host, a row per token: host, class_id, parent_class (the class
    it is nested in, 0 for none), in_template (it stands in an element of a valid class),
    token, is_text, n_pages, host_pages, least and most (occurrences in a page)."""
    tokens = _with_host(pages).select("host", "html").mapInArrow(_tokens, "host string, page bigint, token bigint, parent bigint, is_text boolean, n bigint")
    scratch = scratch or Scratch()
    once = scratch.saved(tokens.groupBy("host", "token", "parent", "is_text", "page").agg(F.max("n").alias("n")), "tokens")
    host_pages = once.where("parent = 0").groupBy("host").agg(F.countDistinct("page").alias("host_pages")).where(f"host_pages >= {MIN_SUPPORT}")
    vectors = once.groupBy("host", "token", "parent", "is_text").agg(
        F.count("*").alias("n_pages"), F.min("n").alias("least"), F.max("n").alias("most"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"))
    near = scratch.saved(vectors.join(host_pages, "host").where(f"n_pages >= greatest({MIN_SUPPORT}, {MIN_SHARE} * host_pages)"), "vectors")
    valid = near.groupBy("host", "vector", "n_pages").agg(F.count("*").alias("n_tokens"), F.min("token").alias("class_id")).where(f"n_tokens >= {MIN_TOKENS}")
    classed = near.join(valid, ["host", "vector", "n_pages"])
    holder = classed.where("not is_text").select("host", F.col("token").alias("parent"), F.col("class_id").alias("parent_class"))
    return classed.join(holder, ["host", "parent"], "left").select(
        "host", "class_id", F.when(F.col("parent_class") != F.col("class_id"), F.col("parent_class")).otherwise(0).alias("parent_class"),
        F.col("parent_class").isNotNull().alias("in_template"), "token", "is_text", "n_pages", "host_pages", "least", "most")


def _main_text(page: str, template: frozenset) -> str:
    found = [x for x in blocks(page) if not x[2]]
    marked = [text for _, text, _, article in found if article]
    if marked:
        return "\n\n".join(marked)
    return "\n\n".join(x[1] for x, token in zip(found, _text_tokens(found)) if token not in template)


def _extract(batches):
    for batch in batches:
        texts = [_main_text(page or "", frozenset(known or ())) for page, known in zip(batch.column("html").to_pylist(), batch.column("known").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (main text, blocks joined by an empty line), n_chars."""
    small_batches(pages.sparkSession)
    # a template's texts are as many as a page can hold twice over, as each is on half of the pages
    scratch = Scratch()
    known = saved(template_tokens(pages, scratch).where("is_text and in_template").groupBy("host").agg(F.collect_set("token").alias("known")), "templates")
    scratch.clear()
    rows = _with_host(pages).join(known, "host", "left").select("page_id", "url", "html", "known")
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")


def op6(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
