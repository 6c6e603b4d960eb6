"""Main text of web pages, by deducing the template of a host.

1. Every page becomes tokens: its elements by path (names and classes from the root) and
   its text blocks by path and wording.
2. For each host, tokens are summed over pages into fingerprints of their occurrence vectors.
   Tokens of equal vectors form an equivalence class. The class that stands exactly once on
   every page is the template's skeleton. Another class is valid if it stands at most once on a
   page, on ``SUPPORT`` of the host's pages (repeats included), and holds an element together with all text under
   it: the same box with the same words. Such classes nest in the skeleton by path.
3. What remains are slots. The main slot is the article or main element of the skeleton, or else
   the deepest skeleton element around ``HELD`` of the text that varies between pages, outside
   links and page furniture.
4. Each page gives the blocks of the main slot, without furniture and valid classes nested in
   it. Blocks of the skeleton class are part of the template too, but not in article and main
   elements: there, only boxes are, and headings, paragraphs, lists and tables stay.

One rule holds for all hosts of two distinct pages or more. A class needs two distinct pages;
where nothing in the main slot varies, nothing in it tells a template from text and all stays.
Hosts of one page have nothing to compare and take the skeleton of all hosts together.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from prismatica.llm.common import ship, stored

ship(sys.modules[__name__])

SUPPORT, HELD = 0.1, 0.9
SUMS = ["pages", "total", "vector", "chars", "every", "furniture"]
EVERY = "*"  # the key for all hosts together; no host name has this form

# Element kinds of HTML.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("nav header footer aside form button select option menu dialog head object audio video canvas".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar side aside widget comment comments comment-list reply replies disqus respond notice notices cookie "
    "cookies consent gdpr alert popup modal overlay newsletter subscribe signup share sharing social related recommended recommendations "
    "pagination pager toolbar login search skip toc".split())
# Words that beside a furniture name leave it one ("share-count", but not "has-sidebar").
PLAIN_NAMES = frozenset(
    "link links list item items count counts bar box button buttons icon icons area block container wrap wrapper inner section content "
    "title text form group row panel menu nav top bottom left right site page main global primary secondary the to".split())
MAIN = ("article", "main")
TEXT_ELEMENTS = ("h1 h2 h3 h4 h5 h6 p pre blockquote ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption").split()
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(" + "|".join(RAW) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)"
                   r"|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}


def _opened(tag: str) -> tuple[str, str, bool]:
    """Name, name with classes, and whether the element is page furniture."""
    name = re.match(r"<([a-zA-Z][\w:-]*)", tag)[1].lower()
    marks = [(k.lower(), a or b or c) for k, a, b, c in ATTRIBUTE.findall(tag)]
    classes = " ".join(v for k, v in marks if k == "class").lower().replace("/", "|").split()
    furniture = name in FURNITURE or (name not in ("html", "body", *MAIN) and any(_named(w) for _, v in marks for w in v.lower().split()))
    return name, ".".join([name, *sorted(classes)]), furniture


def _named(word: str) -> bool:
    """Whether a class, id or role as a whole names furniture: it is listed, or one of its parts
    is and the others are listed, plain or numbers."""
    if word in FURNITURE_NAMES:
        return True
    parts = [w for w in re.split(r"[-_]+", word) if w and not w.isdigit()]
    return not FURNITURE_NAMES.isdisjoint(parts) and all(w in FURNITURE_NAMES or w in PLAIN_NAMES for w in parts)


class _Tags(dict):
    """What ``_opened`` says of each start tag, remembered up to a bound."""

    def __missing__(self, tag: str) -> tuple[str, str, bool]:
        if len(self) > 100_000:
            self.clear()
        found = self[tag] = _opened(tag)
        return found


def _wrappers(marks: list[list], total: int, free: int, mains: list[list[int]]) -> list[bool]:
    """Which marked elements are no furniture, as they wrap the page's text. Outside article and
    main those that hold a main element, over half of the non-link text, or over half of the text
    of articles where that is no less than the text outside all marks; within one, forms with
    over half of its text, and others if it has none outside marks."""
    out = []
    for _, _, within, form, held, articles, has_main in marks:
        if within:
            inner, outside = mains[within - 1]
            out.append(2 * held > inner and (form or not outside))
        else:
            out.append(has_main or 2 * held > total or (2 * articles > sum(m[0] for m in mains) and articles >= free))
    return out


def blocks(page: str, tags: _Tags | None = None) -> list[tuple[str, int, int, str, int]]:
    """(path, furniture, element number, text, characters in links) of each block in order;
    an element's start is a block without text. Furniture is the depth of the innermost
    furniture element around the block, or 0; elements that wrap the page's text are none.
    Unclosed elements end with their parent. Inline furniture is cut out of the text around it."""
    tags = _Tags() if tags is None else tags
    out: list[tuple[str, int, int, str, int]] = []
    # name, path, mark, inline elements open in it, text around an inline one (else None), whether its end tag came, outermost main
    stack: list[list] = []
    marks: list[list] = []  # depth, mark around it, outermost main around it, form, its text, that of mains in it, whether it holds a main element
    mains: list[list[int]] = []  # outermost article and main elements: text, text outside marks in it
    around_main: list[int] = []  # the mark around each
    total = free = 0
    buffer: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked, total, free
        text = " ".join(html.unescape("".join(buffer)).split())
        if text:
            path, mark, within = (stack[-1][1], stack[-1][2], stack[-1][6]) if stack else ("", 0, 0)
            out.append((path, mark, 0, text, linked))
            size = max(0, len(text) - linked)
            total += size
            if not mark:
                free += size
            if within:
                mains[within - 1][0] += size
                if mark == around_main[within - 1]:
                    mains[within - 1][1] += size
            while mark:
                m = marks[mark - 1]
                m[4] += size
                if within and not m[2]:
                    m[5] += size
                mark = m[1]
        buffer.clear()
        linked = 0

    def close(n: int) -> None:
        """Ends the elements from the nth on, and inline ones around them whose end tag came before."""
        nonlocal buffer, linked, links
        while len(stack) > n or (stack and stack[-1][5]):
            flush()
            if (around := stack.pop()[4]) is not None:
                buffer, linked, links = around

    at, links, top = 0, 0, []  # top: inline elements open outside all others
    for m in TOKEN.finditer(page):
        if m.start() > at:
            buffer.append(page[at:m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        tag = m[0]
        if m[1] or tag[1] in "!?":
            if tag[:9] == "<![CDATA[":
                buffer.append(html.escape(tag[9:].removesuffix("]]>"), quote=False))
            continue
        if tag[1] == "/":
            name = re.match(r"</([a-zA-Z][\w:-]*)", tag)[1].lower()
            if name in INLINE:
                for i in range(len(stack), -1, -1):
                    within, pushed = stack[i - 1][3] if i else top, bool(i) and stack[i - 1][0] == name and not stack[i - 1][5]
                    if name in within or pushed:
                        for inner in stack[i - (name not in within):]:  # blocks that are still open in these end first
                            inner[5] = inner[4] is not None
                        close(len(stack))
                        if name in within:
                            del within[len(within) - 1 - within[::-1].index(name)]
                            links = max(0, links - (name == "a"))
                        break
                continue
            flush()
            if (n := next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)) is not None:
                close(n)
                flush()
            links = 0
            continue
        name, label, furniture = tags[tag]
        if name in INLINE and (not furniture or name in VOID):
            if name in ("br", "img", "wbr"):
                buffer.append(" ")
            elif name not in VOID:
                links += name == "a"
                (stack[-1][3] if stack else top).append(name)
            continue
        around = None
        if name in INLINE:
            around, buffer, linked, links = (buffer, linked, links), [], 0, 0
        else:
            flush()
            if name in VOID:
                continue
            while stack:
                n = len(stack) - 1
                while n and stack[n][4] is not None:
                    n -= 1
                if stack[n][0] != "p" and stack[n][0] not in CLOSES.get(name, ()):
                    break
                close(n)
                flush()
            links = 0
        path, mark, within = (stack[-1][1], stack[-1][2], stack[-1][6]) if stack else ("", 0, 0)
        if furniture:
            marks.append([len(stack) + 1, mark, within, name == "form", 0, 0, False])
            mark = len(marks)
        elif name in MAIN:
            if not within:
                mains.append([0, 0])
                around_main.append(mark)
                within = len(mains)
            outer = mark
            while outer and name == "main":
                marks[outer - 1][6] = True
                outer = marks[outer - 1][1]
        stack.append([name, f"{path}/{label}", mark, [], around, False, within])
        out.append((stack[-1][1], mark, 1, "", 0))
    tail = page[at:]
    buffer.append(tail if "<" not in tail else tail[:tail.index("<")] if re.search(r"<[/!a-zA-Z]", tail) else tail)
    close(0)
    flush()
    if not marks:
        return out
    depth = [0]  # by mark: of the innermost one that is furniture
    for m, wraps in zip(marks, _wrappers(marks, total, free, mains)):
        depth.append(depth[m[1]] if wraps else m[0])
    return [(path, depth[mark], opened, text, linked) for path, mark, opened, text, linked in out]


def _host(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", url or "")
    return m[1].lower() if m else ""


def _digest(path: str, text: str) -> str:
    """The token of a text block: 33 characters, then its path."""
    return f"#{xxhash.xxh3_128_hexdigest(text.encode('utf-8', 'surrogatepass'))}{path}"


class _Around(dict):
    """The paths from the outermost element to a path, remembered up to a bound."""

    def __missing__(self, path: str) -> list[str]:
        if len(self) > 50_000:
            self.clear()
        parts = path.split("/")
        found = self[path] = ["/".join(parts[:i]) for i in range(2, len(parts) + 1)]
        return found


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per host and token over a batch: pages, occurrences, vector, non-link characters outside
    furniture, all characters, pages where it is furniture, and the least and greatest page mark."""
    tags, around = _Tags(), _Around()
    for batch in batches:
        sums: dict[tuple[str, str], list] = {}
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            host = _host(url)
            mark = xxhash.xxh3_64_intdigest(page.encode("utf-8", "surrogatepass")) >> 33
            counts: dict[str, list] = {"": [1, 0, 0, 0]}
            for path, furniture, opened, text, linked in blocks(page, tags):
                if opened:
                    counts.setdefault(path, [0, 0, 0, furniture])[0] += 1
                else:
                    free = 0 if furniture else max(0, len(text) - linked)
                    own = counts.setdefault(_digest(path, text), [0, 0, 0, furniture])
                    own[0] += 1
                    for c in (own, *(counts[p] for p in around[path] if p in counts)):
                        c[1] += free
                        c[2] += len(text)
            for token, (n, chars, every, furniture) in counts.items():
                for key in (host, EVERY) if token[:1] != "#" else (host,):
                    s = sums.setdefault((key, token), [0, 0, 0, 0, 0, 0, mark, mark])
                    for i, v in enumerate((1, n, n * mark, chars, every, furniture > 0)):
                        s[i] += v
                    s[6], s[7] = min(s[6], mark), max(s[7], mark)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums]), *[pa.array([s[i] for s in sums.values()], pa.int64()) for i in range(8)]],
            names=["host", "token", *SUMS, "low", "high"])


def _nested(texts: DataFrame) -> DataFrame:
    """Text tokens, once for each element around them (``within``)."""
    parts = F.split(F.substr("token", F.lit(34)), "/")
    around = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return texts.filter(F.size(parts) > 1).withColumn("within", F.explode(around))


def templates(pages: DataFrame, support: float = SUPPORT, held: float = HELD) -> DataFrame:
    """(host, slot, fixed): for each host of two distinct pages or more, and for all together under ``EVERY``, the path
    of the main slot and what of it is template: paths of elements, and tokens of text blocks that the skeleton class holds.

    A host's list is no longer than a page's elements over ``support``, whatever its number of pages.
    """
    sums = pages.mapInArrow(_tokens, "host string, token string, " + ", ".join(f"{c} long" for c in [*SUMS, "low", "high"]))
    tokens = sums.groupBy("host", "token").agg(*[F.sum(F.col(c) % (1 << 31) if c == "vector" else F.col(c)).alias(c) for c in SUMS],
                                               F.min("low").alias("low"), F.max("high").alias("high"))
    # What stands on one page, or on repeats of one, is no evidence.
    kept = stored(tokens.filter("low != high and (token = '' or total = pages)").drop("low", "high"))
    roots = kept.filter("token = ''").select("host", F.col("pages").alias("n"), F.col("vector").alias("root"))
    classed = kept.filter("token != ''").join(roots, "host").withColumn("skeleton", F.expr("vector = root and pages = n"))
    elements, texts = classed.filter("token not like '#%'"), classed.filter("token like '#%'")
    # The main slot: varying text of each skeleton element.
    still = _nested(texts.filter("skeleton")).groupBy("host", F.col("within").alias("token")).agg(F.sum("chars").alias("still"))
    name = F.regexp_extract("token", r"/([^/.]+)[^/]*$", 1)
    kind = F.when(name == "article", 2).when(name == "main", 1).otherwise(0)
    skeleton = (elements.filter("skeleton and 2 * furniture <= pages").join(still, ["host", "token"], "left")
                .select("host", "token", "chars", kind.alias("kind"), (F.col("chars") - F.coalesce("still", F.lit(0))).alias("varying")))
    most = skeleton.groupBy("host").agg(F.max("varying").alias("most"))
    rank = F.struct("kind", F.when(F.col("kind") > 0, F.col("chars")).otherwise(0), F.size(F.split("token", "/")).alias("depth"), "varying", "token")
    slots = (skeleton.join(most, "host").filter((F.col("kind") > 0) | (F.col("varying") >= held * F.col("most"))).groupBy("host")
             .agg(F.max(rank).alias("best")).select("host", F.col("best.token").alias("slot"), F.col("best.varying").alias("varying")))
    # Valid classes: elements whose whole text is of their own class.
    fixed_text = _nested(texts.filter(F.col("pages") >= support * F.col("n"))).groupBy("host", "within", "vector", "pages").agg(F.sum("every").alias("same"))
    in_main = F.col("token").rlike(r"/(article|main)(\.[^/]*)?/")
    boxes = elements.withColumnRenamed("token", "within").join(fixed_text, ["host", "within", "vector", "pages"]).filter("same = every").select(
        "host", F.col("within").alias("token"))
    boxes = boxes.filter(~in_main | ~name.isin(TEXT_ELEMENTS))
    words = texts.filter("skeleton").filter(~in_main & ~F.col("token").rlike(r"/(article|main)(\.[^/]*)?$")).select("host", "token")
    inside = boxes.unionByName(words).join(slots, "host").filter(
        (F.col("varying") > 0) & ~F.startswith(F.concat("slot", F.lit("/")), F.concat("token", F.lit("/")))).groupBy("host").agg(F.collect_set("token").alias("fixed"))
    return slots.select("host", "slot").join(inside, "host", "left")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tags, around = _Tags(), _Around()
    for batch in batches:
        texts = []
        for page, slot, template in zip(*(batch.column(c).to_pylist() for c in ("html", "slot", "fixed"))):
            found, fixed = blocks(page, tags), set(template or ())
            paths = {b[0] for b in found if b[2]}
            inside = [b for b in found if b[2] and b[0].rsplit("/", 1)[-1].split(".")[0] in MAIN and not b[1]]
            if not slot or slot not in paths or (inside and not any(f"/{m}" in slot for m in MAIN)):
                slot = inside[0][0] if inside else ""
            starts = [b[1] for b in found if b[2] and b[0] == slot]
            outer = starts[0] if len(starts) == 1 else 0  # what lies around the slot says nothing on its blocks
            kept = [b[3] for b in found if not b[2] and b[1] <= outer and (b[0] == slot or b[0].startswith(slot + "/"))
                    and not (fixed and (any(p in fixed for p in around[b[0]] if len(p) > len(slot)) or _digest(b[0], b[3]) in fixed))]
            texts.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         names=[*batch.schema.names[:-3], "text", "n_chars"])


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of each page: the blocks of its main slot, one a line.

    A null or empty page has an empty text; a null or odd url belongs to the nameless host.
    Equal pages have equal texts within a host. Extra columns are not read.
    """
    kinds = dict(pages.dtypes)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))
    source = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(page), F.lit("")).alias("html"))
    found = stored(templates(source.select("url", "html")))
    shared = found.filter(F.col("host") == EVERY).select("slot").first()
    joined = source.withColumn("host", host).join(found.filter(F.col("host") != EVERY), "host", "left").select(
        "id", "url", "html", F.coalesce("slot", F.lit(shared[0] if shared else None)).alias("slot"), "fixed")
    result = joined.mapInArrow(_extracted, f"id {kinds[key]}, url string, text string, n_chars long")
    return result.select(F.col("id").alias(key), F.col("url").alias(url), "text", "n_chars")
