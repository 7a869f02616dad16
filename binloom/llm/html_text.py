"""HTML main text by nearest-URL page differencing.

Each page is read as text lines (the text of its blocks), each with a zone: inside an article or main element,
elsewhere in the body, or in an element that never holds main text (menus, forms, scripts, comment lists ...).
Pages are range-sorted by host and URL path, over all tasks; each is paired with its neighbours of the same host,
and their lines are aligned by longest common subsequence. A shared line goes. Inside the article
of both pages it goes only if all further neighbours, three at least, hold it too (copies of the page do not count):
the host repeats it on page after page, where articles that quote the same passage stand apart. A pair that shares more than it
leaves over may be copies of one page: there a line goes if a further neighbour holds it that does not hold most of
what the pair shares, or that is a third page with lines of its own. A page without a neighbour has only the evidence: its article, if it has one, is its text.
Only line hashes are sorted and shuffled.

Edge cases: null and empty html give an empty text. Unclosed and stray tags, comments and broken character
references are read as browsers do. A null URL pairs with no page. Rows that repeat a page (page_id and html) are
not differenced against each other, nor are neighbours of equal lines. Pages of equal URLs are neighbours in the order
of page_id. A very long page is one row of html and one of line hashes. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from html import unescape
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, stored

# Elements by what they mean for the main text.
DROPPED = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button form nav footer aside dialog menu head title figcaption".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
# Words in class, id and role attributes that mark what is not main text.
CHROME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|header|masthead|footer|sidebar|side|aside|complementary|contentinfo|"
    r"cookies?|consent|notice|gdpr|popup|modal|overlay|comments?|commentlist|disqus|replies|respond|related|recommend\w*|share|sharing|social|newsletter|subscribe|signup|login|search|widget|toolbar|pagination|pager)(?:$|[\s_-])",
    re.IGNORECASE,
)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
SPACE = re.compile(r"\s+")

ARTICLE, BODY = 1, 0
Line = tuple[str, int]
#: Further neighbours that are looked at on each side of a pair, and pages that a decision reaches on each side.
FURTHER = 3
REACH = FURTHER + 1
#: Further neighbours that have to hold a line of an article for it to go.
SURE = 3


def _chrome(attributes: str, name: str) -> bool:
    if name in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id", "role") and CHROME.search(value):
            return True
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def page_lines(html: str | None) -> list[Line]:
    """The text blocks of a page outside elements that never hold main text, each with its zone."""
    out: list[Line] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, main: of the element and those around it
    at, html = 0, html or ""

    def block() -> None:
        if held:
            text = SPACE.sub(" ", unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append((text, ARTICLE if stack and stack[-1][2] else BODY))

    while True:
        m = TOKEN.search(html, at)
        end = m.start() if m else len(html)
        if end > at and not (stack and stack[-1][1]):
            held.append(html[at:end])
        if not m:
            break
        at = m.end()
        if not (name := (m[2] or "").lower()):
            continue
        inside = stack[-1] if stack else ("", False, False)
        if m[1]:
            if any(s[0] == name for s in stack):
                if name not in INLINE:
                    block()
                while stack.pop()[0] != name:
                    pass
            elif name not in INLINE:
                block()
        elif name in INLINE:
            if name == "br":
                held.append(" ")
            elif name not in VOID:
                # An inline element is tracked only if it drops text; it ends at the latest with its block.
                if _chrome(m[3], name) and not m[3].endswith("/"):
                    stack.append((name, True, inside[2]))
        else:
            block()
            if name == "p" or name in ("div", "li", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "blockquote", "pre"):
                while stack and stack[-1][0] == "p":
                    stack.pop()  # a block ends an open paragraph
            inside = stack[-1] if stack else ("", False, False)
            if name in VOID or m[3].endswith("/") and name not in ("p", "div", "li"):
                continue
            main = inside[2] or name in MAIN
            header = name == "header" and not inside[2]
            stack.append((name, inside[1] or name in DROPPED or header or _chrome(m[3], name), main))
            if name in RAW:
                close = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(html, at)
                at = close.start() if close else len(html)
    block()
    return out


def url_key(url: str | None) -> tuple[str | None, str | None]:
    """Host and path of a URL; query and fragment do not count."""
    try:
        u = urlsplit((url or "").strip())
        host = u.netloc.rpartition("@")[2].lower()
    except ValueError:
        return None, None
    return (host or None), re.sub(r"(\.\w+|/)$", "", u.path)


def common_lines(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Positions in a and b of a longest common subsequence (Hunt and Szymanski)."""
    at = defaultdict(list)
    for j, x in enumerate(b):
        at[x].append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(at.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    p, q, link = [], [], links[-1] if links else None
    while link:
        p.append(link[0])
        q.append(link[1])
        link = link[2]
    return p[::-1], q[::-1]


def _shared(x: dict, y: dict, further: list[dict]) -> set[int]:
    """Positions of the lines that x shares with its neighbour y and loses."""
    p, q = common_lines(x["lines"], y["lines"])
    size = sum(x["sizes"][i] for i in p)
    copies = size > min(sum(x["sizes"]), sum(y["sizes"])) - size
    alone = len(p) < min(len(x["lines"]), len(y["lines"]))
    held = [set(n["lines"]) for n in further]
    like = [2 * sum(x["sizes"][i] for i in p if x["lines"][i] in h) > size for h in held]
    third = [alone and not h <= {x["lines"][i] for i in p} for h in held]

    def goes(i: int, j: int) -> bool:
        article = x["main"][i] and y["main"][j]
        seen = [n for n, h in enumerate(held) if x["lines"][i] in h]
        if article:
            others = [n for n in range(len(held)) if not (copies and like[n])]
            return len(others) >= SURE and set(others) <= set(seen)
        if copies:
            return any(not like[n] or third[n] for n in seen)
        return True

    return {i for i, j in zip(p, q, strict=True) if goes(i, j)}


def _lost(run: list[dict], i: int) -> list[int]:
    """Positions of the lines that page ``i`` of a run of URL neighbours loses."""
    x, lost, met = run[i], set(), False
    same = [k for k in range(max(i - REACH, 0), min(i + REACH + 1, len(run))) if run[k]["host"] == x["host"] is not None and run[k]["lines"]]
    for j in (i - 1, i + 1):
        if j in same:
            lo, hi = min(i, j) - FURTHER, max(i, j) + FURTHER
            lost |= _shared(x, run[j], [run[k] for k in same if lo <= k <= hi and k not in (i, j)])
            met = True
    if not met and any(x["main"]):
        return [k for k, main in enumerate(x["main"]) if not main]
    return sorted(lost)


def _append(run: list[dict], page: dict) -> bool:
    """Add a page to a run, with its row; pages of equal lines next to each other are one. False where it was there."""
    key = (page["page_id"], page["row"])
    if run and run[-1]["host"] == page["host"] and (page["lines"] is None or run[-1]["lines"] == page["lines"] and run[-1]["main"] == page["main"]):
        run[-1]["rows"].append(key)
        return False
    run.append(page | {"rows": [key]})
    return True


PROFILE = "page_id long, row long, host string, path string, lines array<long>, sizes array<int>, main array<boolean>"


def profiles(pages: DataFrame) -> DataFrame:
    """Per page its place among URLs and its lines as hashes, sizes and zones; no text."""

    def run(batches):
        import pandas as pd
        import pyarrow as pa

        for b in batches:
            rows = []
            for page, row, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines, key = page_lines(html), url_key(url)
                hashes = pd.util.hash_array(pd.Series([t for t, _ in lines], dtype=object).to_numpy(), categorize=False).view("int64").tolist() if lines else []
                rows.append((page, row, *key, hashes, [len(t) for t, _ in lines], [z == ARTICLE for _, z in lines]))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "row", "host", "path", "lines", "sizes", "main"])

    return pages.select("page_id", F.xxhash64("html").alias("row"), "url", "html").mapInArrow(run, PROFILE)


def lost_lines(pages: DataFrame) -> DataFrame:
    """(page_id, row, lost): the positions of the lines that a page shares with its nearest URLs and loses."""
    fields = PROFILE + ", part int, place int, lost array<int>"

    def sweep(batches):
        """Decides the pages within a task; the first and last come out whole, to meet those of the next tasks."""
        import pyarrow as pa
        from pyspark import TaskContext

        part, run, n, done = TaskContext.get().partitionId(), [], 0, []
        schema = pa.schema([("page_id", pa.int64()), ("row", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("main", pa.list_(pa.bool_())), ("part", pa.int32()), ("place", pa.int32()), ("lost", pa.list_(pa.int32()))])
        names = schema.names[2:7]

        def decide(i: int) -> None:
            if lost := _lost(run, i):
                done.extend(dict.fromkeys(names) | {"page_id": k, "row": r, "part": part, "place": -1, "lost": lost} for k, r in run[i]["rows"])

        def edge(i: int, place: int) -> None:
            for at, (k, r) in enumerate(run[i]["rows"]):
                shown = {c: run[i][c] if at == 0 or c == "host" else None for c in names}
                done.append(shown | {"page_id": k, "row": r, "part": part, "place": place, "lost": []})

        # ``n`` pages so far; the last is still open to rows of equal lines, those before it are closed.
        for b in batches:
            for page in b.to_pylist():
                if not _append(run, page):
                    continue
                n += 1
                if 2 <= n <= 2 * REACH + 1:
                    edge(-2, n - 2)
                if n - 2 - REACH >= REACH:
                    decide(len(run) - 2 - REACH)
                del run[: -2 * REACH - 2]
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done.clear()
        base = n - len(run)
        if n - 1 - REACH >= REACH:
            decide(n - 1 - REACH - base)
        for place in range(max(n - 2 * REACH, min(n - 1, 2 * REACH), 0), n):
            edge(place - base, place)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    ranged = profiles(pages).repartitionByRange("host", "path", "page_id", "row").sortWithinPartitions("host", "path", "page_id", "row")
    swept = stored(ranged.mapInArrow(sweep, fields), "page-lines")
    # Up to 4 x REACH pages of each task, in task order; those within REACH of its ends are decided here.
    run: list[dict] = []
    for e in swept.where("place >= 0").orderBy("part", "place", F.col("lines").isNull()).toLocalIterator():
        _append(run, e.asDict())
    size = {e["part"]: e["place"] + 1 for e in run}
    met = []
    for i, e in enumerate(run):
        if not REACH <= e["place"] < size[e["part"]] - REACH and (lost := _lost(run, i)):
            met += [(k, r, lost) for k, r in e["rows"]]
    kept = swept.where(F.size("lost") > 0).select("page_id", "row", "lost")
    kept = kept.unionByName(pages.sparkSession.createDataFrame(met, "page_id long, row long, lost array<int>"))
    return kept.groupBy("page_id", "row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lost")))).alias("lost"))


def main_text(lines: list[Line], lost: list[int] | None) -> str:
    gone = set(lost or ())
    return "\n\n".join(t for i, (t, _) in enumerate(lines) if i not in gone)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``."""
    lost = stored(lost_lines(pages), "lost-lines")
    rows = pages.select("page_id", "url", "html", F.xxhash64("html").alias("row"))
    joined = rows.join(maybe_broadcast(lost, lost.count(), 128), ["page_id", "row"], "left").select("page_id", "url", "html", "lost")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            text = [main_text(page_lines(h), k) for h, k in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
