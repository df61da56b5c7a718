"""Main text of web pages by template deduction from equivalence classes (9).

Tokens of a page are its elements, told apart by name, class and place among their siblings on every level,
and its whole text blocks. Over all pages of a host, tokens with the same occurrence vector form a class. As
an element's path holds its ancestors, the tokens of a class are nested, and a class of fewer pages lies in a
slot of one of more: the classes together are the template. A text is the template's if an element around it
is in its own class (it stands wherever that element stands), and is dropped. Of the slots that remain, the
article's is the deepest element on most pages that still holds most of the text that is left.

Hosts with too few different pages are pooled with others of the same frame (the elements below body); a page
without such a pool is judged by its own elements, its article or main tag first.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import slices, written
from alertmill.llm.textops import mix

#: Different pages (by their longest blocks) from which on those of a host or frame are compared, and on which a class must be.
LEAST_PAGES = 4
#: Share of a group's own text that the article's slot holds, of its pages that have that slot, and of its pages that a class is on.
MOST, USUAL, COMMON = 0.6, 0.5, 0.01
#: Templates that are sent to all tasks: 100,000 hosts of some 100 bytes and a million tokens of 8. Salts of a larger table.
SENT_HOSTS, SENT_TOKENS, SALTS = 100_000, 1_000_000, 64
#: Levels of elements that paths tell apart (deeper ones stand beside each other on the last), and characters of a name, beyond which a hash stands for its classes: bounds of a path.
DEEPEST, LONGEST = 64, 60
_OPEN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Fixed values of HTML.
_RAW = frozenset("script style textarea title noscript iframe xmp noframes template".split())
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label map mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("html body article main section div aside nav header footer form table td th ul ol dl blockquote button".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section table ul".split())
_MAIN = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements inside an article: none of them is a slot by itself.
_TEXT = _HEADINGS | frozenset("p ul ol li dl dt dd blockquote pre figure figcaption caption table thead tbody tfoot tr th address details summary hgroup".split())
# What is not the article wherever it stands, by tag and by the words of class, id and role.
_OUT_TAGS = frozenset("nav footer aside form button select menu dialog svg math canvas object audio video".split())
_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr login menu modal "
    "nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
_HEADER = "header"


class _Ends:
    """Where the tags of a page end: at the first > outside quotes. Places from which none was found are kept, so all searches together take time in proportion to the page."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.vain: set[int] = set()  # quotes that opened on the way to no end
        self.start = self.first = -1  # the first mark from start on

    def find(self, at: int) -> int:
        """Index of the > that ends a tag whose name ends at at; none: -1. Calls go from left to right."""
        if not 0 <= self.start <= at <= self.first:
            self.start, self.first = at, self._mark(at)
        place, opened = self.first, []
        while place < len(self.html) and place not in self.vain:
            if self.html[place] == ">":
                return place
            opened.append(place)
            close = self.html.find(self.html[place], place + 1)
            if close < 0:
                break
            place = self._mark(close + 1)
        self.vain.update(opened)
        return -1

    def _mark(self, at: int) -> int:
        m = _MARK.search(self.html, at)
        return m.start() if m else len(self.html)


class Page:
    """Elements (by their paths) and text blocks of one page, read in time and memory in proportion to it, however deep or broken."""

    def __init__(self, html: str) -> None:
        self.paths: list[str] = []  # of each block element, all different: /name[place among siblings of the name] on every level up to DEEPEST
        self.blocks: list[tuple[str, str, bool, bool]] = []  # path, text, left out, inside an article
        self.frame: set[str] = set()
        # open elements: tag, path, left out, inside an article, and of its children the path before theirs and their numbers by name
        stack: list[tuple[str, str, bool, bool, str, dict[str, int]]] = [("", "", False, False, "", {})]
        opened: dict[str, list[int]] = defaultdict(list)  # where each tag is in stack
        scopes = [0]
        held: list[str] = []

        def flush() -> None:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                self.blocks.append((stack[-1][1], text, stack[-1][2], stack[-1][3]))

        def leave(i: int) -> None:
            while len(stack) > i:
                tag = stack.pop()[0]
                opened[tag].pop()
                if tag in _SCOPES:
                    scopes.pop()

        ends, last, at = _Ends(html), html.rfind(">"), 0
        while at < len(html):
            if html[at] != "<":
                end = html.find("<", at)
                end = end if end >= 0 else len(html)
                held.append(entities.unescape(html[at:end]))
                at = end
                continue
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                at = end + 3 if end >= 0 else len(html)
                continue
            if html.startswith(("<!", "<?"), at) and at + 2 <= last:
                flush()
                at = html.find(">", at + 2) + 1
                continue
            m = _OPEN.match(html, at)
            end = ends.find(m.end()) if m else -1
            if end < 0:
                held.append("<")
                at += 1
                continue
            close, tag, attributes, at = m.group(1), m.group(2).lower(), html[m.end() : end], end + 1
            if not close and tag in _RAW:
                found = _END[tag].search(html, at)
                end = html.find(">", found.end()) if found else -1
                at = end + 1 if end >= 0 else len(html)
                continue
            if tag in _INLINE:
                if tag == "br":
                    held.append(" ")
                continue
            flush()
            if close:
                if opened[tag] and (tag in _SCOPES or opened[tag][-1] >= scopes[-1]):
                    leave(opened[tag][-1])
                continue
            gone = _CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
            top = max((opened[t][-1] for t in gone if opened[t]), default=-1)
            if top >= scopes[-1]:
                leave(top)
            own = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
            words = set(re.findall(r"[a-z]+", " ".join(own.get(k, "") for k in ("class", "id", "role")).lower())) if own else set()
            above, _, out, main, path, children = stack[-1]
            main_here = tag in _MAIN or own.get("role") == "main" or own.get("itemprop") == "articleBody"
            out = out or tag in _OUT_TAGS or "hidden" in own or "display:none" in own.get("style", "").replace(" ", "") or own.get("aria-hidden") == "true"
            out = out or (tag not in ("html", "body") and not main_here and bool(words & _OUT_WORDS)) or (not main and not main_here and (tag == _HEADER or (_HEADER in words and tag not in ("html", "body"))))
            name = ".".join([tag, *sorted(re.findall(r"[a-z0-9_-]+", own.get("class", "").lower()))]) if own else tag
            if len(name) > LONGEST:
                name = f"{tag[: LONGEST - 20]}.{xxhash.xxh64_hexdigest(name)}"
            if above in ("body", "html", "") and tag not in ("html", "head", "body") and tag not in _TEXT and tag not in _VOID:
                self.frame.add(name)
            children[name] = children.get(name, 0) + 1
            here = f"{path}/{name}[{children[name]}]"
            self.paths.append(here)
            if tag not in _VOID:
                opened[tag].append(len(stack))
                if tag in _SCOPES:
                    scopes.append(len(stack))
                stack.append((tag, here, out, main or main_here, *((here, {}) if len(stack) < DEEPEST else (path, children))))
        flush()


_PLACES = re.compile(r"\[\d+\]")


def _tag(path: str) -> str:
    """The tag of a path's last element."""
    return re.split(r"[.\[]", path.rpartition("/")[2], maxsplit=1)[0]


def _container(path: str) -> str:
    """The innermost element of a path that is no part of a running text."""
    while path and _tag(path) in _TEXT:
        path = path.rpartition("/")[0]
    return path


def _name(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) - (1 << 63)


def text_token(path: str, text: str) -> int:
    """A text block by its elements' names, not their places: a block before it may be missing."""
    return _name("text", _PLACES.sub("", path), text)


def host(url):
    """Lower-cased host of a URL column; null or no URL: empty."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, key, frame, body (a hash of the three longest blocks), paths, and of each block: path (its index, -1: none), text, flags (1: left out, 2: inside an article)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            frames, bodies, paths, at, texts, flags = [], [], [], [], [], []
            for html in part.column("html").to_pylist():
                page = Page(html)
                index = {p: i for i, p in enumerate(page.paths)}
                frames.append(_name(*sorted(page.frame)))
                bodies.append(_name(*sorted((b[1] for b in page.blocks), key=lambda t: (-len(t), t))[:3]))
                paths.append(page.paths)
                at.append([index.get(b[0], -1) for b in page.blocks])
                texts.append([b[1] for b in page.blocks])
                flags.append([b[2] + 2 * b[3] for b in page.blocks])
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(c) for c in ("page_id", "url", "host", "key")], pa.array(frames, pa.int64()), pa.array(bodies, pa.int64()), pa.array(paths, pa.list_(pa.string())),
                    pa.array(at, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string())), pa.array(flags, pa.list_(pa.int32())),
                ], names=["page_id", "url", "host", "key", "frame", "body", "paths", "at", "texts", "flags"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "host", "key", "html").mapInArrow(run, f"page_id {kind}, url string, host string, key long, frame long, body long, paths array<string>, at array<int>, texts array<string>, flags array<int>")


#: Kinds of rows of occurrences(): elements, texts, and the text that stands in an element.
ELEMENT, TEXT, HELD = range(3)
_SUMS = ["n_pages", "n_times", "v1", "v2", "n_chars", "n_heading"]


def occurrences(pages: DataFrame) -> DataFrame:
    """host, frame, kind, token, path, n_pages, n_times, v1, v2, n_chars, n_heading, body_min, body_max of parsed(); combined in tasks, then by host, frame and token.

    v1, v2: sums of 32 bits each of a hash for (page, times): equal for tokens with equal occurrence vectors, and
    copies of a page do not cancel each other. HELD rows have the characters in a container, and those in headings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                yield one(batch.slice(start, 256))

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[tuple, list] = {}
        for h, frame, key, body, paths, at, texts, flags in zip(*[part.column(c).to_pylist() for c in ("host", "frame", "key", "body", "paths", "at", "texts", "flags")], strict=True):
            times: dict[tuple[int, int], list] = {(ELEMENT, _name("tag", p)): [p, 1, 0, 0] for p in paths}
            held: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for i, text, flag in zip(at, texts, flags, strict=True):
                path = paths[i] if i >= 0 else ""
                t = times.setdefault((TEXT, text_token(path, text)), [path, 0, 0, 0])
                t[1] += 1
                if not flag & 1:
                    t[2] += len(text)
                    own = held[_container(path)]
                    own[0] += len(text)
                    if _tag(path) in _HEADINGS:
                        own[1] += len(text)
                        t[3] += len(text)
            for path, (n, heading) in held.items():
                times[HELD, _name("held", path)] = [path, 1, n, heading]
            numbers = np.fromiter((t[1] for t in times.values()), np.uint64, len(times))
            hashes = mix(np.uint64(key % (1 << 64)) + numbers * np.uint64(0x9E3779B97F4A7C15))
            for (kind, token), t, v in zip(times, times.values(), hashes.tolist(), strict=True):
                row = found.setdefault((h, frame, kind, token), [t[0], 0, 0, 0, 0, 0, 0, body, body])
                for j, x in enumerate((1, t[1], v & 0xFFFFFFFF, v >> 32, t[2], t[3]), 1):
                    row[j] += x
                row[7], row[8] = min(row[7], body), max(row[8], body)
        keys, rows = list(found), list(found.values())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int32()), pa.array([k[3] for k in keys], pa.int64()),
                pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 9)],
            ], names=["host", "frame", "kind", "token", "path", *_SUMS, "body_min", "body_max"],
        )

    rows = pages.select("host", "frame", "key", "body", "paths", "at", "texts", "flags").mapInArrow(run, "host string, frame long, kind int, token long, path string, " + ", ".join(f"{c} long" for c in _SUMS) + ", body_min long, body_max long")
    return _summed(rows, "host", "frame")


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "kind", "token").agg(F.min("path").alias("path"), *[F.sum(c).alias(c) for c in _SUMS], F.min("body_min").alias("body_min"), F.max("body_max").alias("body_max"))


def groups(pages: DataFrame) -> DataFrame:
    """host, frame, group, n (its pages): a host with LEAST_PAGES different pages is a group, smaller ones are pooled by frame. A frame with fewer has none."""
    own = pages.select("host", "frame", "body").filter("host <> ''").groupBy("host").agg(F.count_distinct("body").alias("n")).filter(F.col("n") >= LEAST_PAGES).select("host", F.concat(F.lit("host "), "host").alias("group"))
    sizes = pages.groupBy("host", "frame").agg(F.count(F.lit(1)).alias("n"))
    named = sizes.join(own, "host", "left").withColumn("group", F.coalesce("group", F.concat(F.lit("frame "), F.col("frame").cast("string"))))
    pooled = pages.select("host", "frame", "body").join(own, "host", "left_anti").groupBy("frame").agg(F.count_distinct("body").alias("n")).filter(F.col("n") >= LEAST_PAGES)
    named = named.join(pooled.select("frame", F.lit(True).alias("pooled")), "frame", "left").filter(F.col("pooled") | F.col("group").startswith("host "))
    return named.join(named.groupBy("group").agg(F.sum("n").alias("all")), "group").select("host", "frame", "group", F.col("all").alias("n"))


def classes(tokens: DataFrame) -> DataFrame:
    """The elements and texts of valid classes: group, kind, token, path, v1, v2, n_pages and the other sums.

    tokens: group, n (pages of the group) and the columns of occurrences(). A valid class is on LEAST_PAGES pages
    and the share COMMON of the group's, and on pages of more than one body (copies of a page make no template).
    Each of its tokens is there once a page. By the shares, a group has a bounded number of such tokens.
    """
    often = (F.col("n_pages") >= LEAST_PAGES) & (F.col("n_pages") >= COMMON * F.col("n"))
    return tokens.filter(F.col("kind").isin(ELEMENT, TEXT) & often & (F.col("n_times") == F.col("n_pages")) & (F.col("body_min") < F.col("body_max")))


def fixed_texts(members: DataFrame) -> DataFrame:
    """group, token, path, n_chars, n_heading of the template's texts: those in the class of a container around them. members: classes()."""
    around = members.filter((F.col("kind") == ELEMENT) & ~F.expr(_IS_TEXT)).select("group", "v1", "v2", "n_pages", F.col("path").alias("element"))
    # a class has few containers: they are nested or side by side in every page that has it
    texts = members.filter(F.col("kind") == TEXT).join(around, ["group", "v1", "v2", "n_pages"]).filter(F.expr("startswith(path, element || '/') or path = element"))
    return texts.groupBy("group", "token").agg(*[F.any_value(c).alias(c) for c in ("path", "n_chars", "n_heading")])


_IS_TEXT = "element_at(split(regexp_replace(path, '.*/', ''), '[.\\\\[]'), 1) in (" + ", ".join(f"'{t}'" for t in sorted(_TEXT)) + ")"
#: From the deepest element up: a parent that adds nothing but headings takes its child's place.
_CLIMB = """aggregate(chain, cast(null as struct<depth:int, path:string, n:bigint, h:bigint>),
  (s, x) -> if(s is null or (x.n - s.n = x.h - s.h and not (x.path rlike '/body[^/]*$' or x.path rlike '/html[^/]*$')), x, s), s -> s.path)"""


def templates(pages: DataFrame) -> DataFrame:
    """host, frame, slot (path of the article's slot; null: none) and fixed (text tokens of the template) of each group's hosts and frames. pages: parsed()."""
    of = written(groups(pages), "page-groups")
    tokens = written(_summed(occurrences(pages).join(of, ["host", "frame"]).select("*"), "group", "n"), "page-tokens")
    members = classes(tokens)
    fixed = written(fixed_texts(members), "page-template")
    usual = members.filter((F.col("kind") == ELEMENT) & (F.col("n_pages") >= USUAL * F.col("n")) & ~F.expr(_IS_TEXT)).select("group", "path")
    # text per container, less what is fixed; a group has few containers, however many pages
    less = fixed.select("group", F.expr(_CONTAINER_OF).alias("path"), (-F.col("n_chars")).alias("n_chars"), (-F.col("n_heading")).alias("n_heading"))
    held = tokens.filter(F.col("kind") == HELD).select("group", "path", "n_chars", "n_heading").unionByName(less).groupBy("group", "path").agg(F.sum("n_chars").alias("n"), F.sum("n_heading").alias("h"))
    total = held.groupBy("group").agg(F.sum("n").alias("total"))
    levels = held.withColumn("parts", F.split("path", "/")).select("group", "n", "h", F.explode(F.expr("transform(sequence(1, size(parts)), i -> array_join(slice(parts, 1, i), '/'))")).alias("path")).filter("path <> ''")
    inside = levels.groupBy("group", "path").agg(F.sum("n").alias("n"), F.sum("h").alias("h")).join(usual, ["group", "path"]).join(total, "group").filter((F.col("n") > 0) & (F.col("n") >= MOST * F.col("total")))
    # elements with more than half of a text lie inside each other: no more than the depth of a page
    chain = F.sort_array(F.collect_list(F.struct((F.size(F.split("path", "/"))).alias("depth"), "path", "n", "h")), asc=False)
    slots = inside.groupBy("group").agg(chain.alias("chain")).select("group", F.expr(_CLIMB).alias("slot"))
    texts = fixed.groupBy("group").agg(F.collect_set("token").alias("fixed"))
    found = of.select("host", "frame", "group").join(slots, "group", "left").join(texts, "group", "left")
    return found.select("host", "frame", "slot", F.coalesce("fixed", F.array().cast("array<bigint>")).alias("fixed"))


_CONTAINER_OF = "regexp_replace(path, '(/(" + "|".join(sorted(_TEXT)) + ")[.\\\\[][^/]*)+$', '')"


def own_slot(blocks: list[tuple[str, str, bool]]) -> str:
    """The slot of a page by itself: the deepest container with the share MOST of its text, or above it one that adds headings alone. blocks: path, text, inside an article."""
    blocks = [b for b in blocks if b[2]] or blocks
    held, heading = defaultdict(int), defaultdict(int)
    for path, text, _ in blocks:
        at = _container(path)
        while True:
            held[at] += len(text)
            heading[at] += len(text) if _tag(path) in _HEADINGS else 0
            if not at:
                break
            at = at.rpartition("/")[0]
    most = MOST * sum(len(t) for _, t, _ in blocks)
    chain = sorted((p for p, n in held.items() if n >= most and _tag(p) not in _TEXT), key=lambda p: -p.count("/"))
    slot = chain[0] if chain else ""
    for p in chain[1:]:
        if held[p] - held[slot] == heading[p] - heading[slot] and _tag(p) not in ("body", "html", ""):
            slot = p
    return slot


def article(paths: list[str], at: list[int], texts: list[str], flags: list[int], slot: str | None, fixed: set[int]) -> str:
    """The blocks of the article's slot, in order, without the template's texts and what is left out wherever it stands. A page without the slot: its own."""
    blocks = [(paths[i] if i >= 0 else "", t, bool(f & 2)) for i, t, f in zip(at, texts, flags, strict=True) if not f & 1]
    if fixed:
        blocks = [b for b in blocks if text_token(b[0], b[1]) not in fixed]
    if slot is None or slot not in paths:
        slot = own_slot(blocks)
    return "\n".join(t for p, t, _ in blocks if not slot or p == slot or p.startswith(slot + "/"))


def _with_template(pages: DataFrame, found: DataFrame) -> DataFrame:
    """pages and their template: sent to all tasks while it has at most SENT_HOSTS rows and SENT_TOKENS tokens, else joined on host, frame and one of SALTS salts."""
    n = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("fixed")), F.lit(0))).first()
    if n[0] <= SENT_HOSTS and n[1] <= SENT_TOKENS:
        return pages.join(F.broadcast(found), ["host", "frame"], "left")
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(salted, ["host", "frame", "salt"], "left")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row of pages, from its whole html (null: empty, and an empty text).

    Pages without a host are pooled by frame. A host may hold any share of the pages: counts are combined before
    they are shuffled, and a template is small, so pages need not be brought together. Pages are read and parsed
    once, into a table. Repeated rows give repeated results; extra columns are not read.
    """
    base = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    base = base.withColumns({"host": host(F.col("url")), "key": F.xxhash64("page_id", "url", F.length("html"))})
    rows = written(parsed(base), "pages-parsed")
    joined = _with_template(rows, written(templates(rows), "templates")).select("page_id", "url", "paths", "at", "texts", "flags", "slot", "fixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [article(*row, set(f or ())) for *row, f in zip(*[part.column(c).to_pylist() for c in ("paths", "at", "texts", "flags", "slot", "fixed")], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {base.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
