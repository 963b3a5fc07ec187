"""Main text of web pages by differencing each page with its nearest page of the same site.

Pages are ordered by host, URL path, id and lines.  Successive pages of a host with the same
lines tell nothing about each other: they are a row of equal pages with one partner, so that
equal pages in a row get equal texts.  The partner is the page before the row or the one after
it, of the same host: the one whose path shares more leading parts with the path of the row's
end beside it (of equals the one before).  The text lines (blocks) of page and partner are
aligned by a longest common subsequence, and the lines that they share are the site's, not the
page's: they are deleted.

Markup tells more about some lines.  Those of elements whose tag or role says they hold menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments go at
once; those of elements that say they hold the article are kept, shared or not (a quotation or a
copied article is still the article); and beside an article, other lines go.  A class name that
sounds like a menu or an advert is evidence only: without an article, lines of such an element
are the text if nothing else of the page is left, less those that the partner shares.

Order without skew: the ordered pages are cut in runs of about equal length by splitters drawn
from a hashed sample of the keys.  A row of equal pages may go on over any number of runs: a
table of keys and line hashes gives the two outermost rows at both ends of each run, and from
these follow, for each run, the page before its first row and the one after its last, wherever
they are.  These two pages are sent to the run as well.  So a host of any size is spread over
many tasks, and each task streams its pages; of a row of equal pages it holds the lines once, and
each page's id and URL.  Only the splitters and those keys, a few for each run, reach the driver.

Defined cases: a null page, or one without text, has the empty text; a null url has the empty
host and path; pages without partner keep all their open lines; of a repeated row each copy
gets the same result; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paysift.llm.common import bounded_batches, written

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)/?>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul""".split())
CHROME_TAGS = frozenset("nav footer aside form button select dialog menu svg math head".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CHROME_NAME = re.compile(r"""(?:^|[-_\s])(?:ads?|adverts?|advertis\w+|adsense|adslot|sponsor\w*|promo\w*|banners?|nav|navbar|navigation|menus?|sidebars?|side|rail|footers?|
headers?|masthead|topbar|breadcrumbs?|comments?|commentlist|disqus|replies|cookies?|consent|gdpr|notices?|notification\w*|alerts?|newsletters?|subscribe|subscription|
signup|popups?|modal|overlay|related|recommend\w*|share|sharing|social|toolbar|pagination|pager|widgets?|login|search|copyright|disclaimer|skip)(?:$|[-_\s\d])""", re.I | re.X)
COMMENT_NAME = re.compile(r"(?:^|[-_\s])(?:comments?|commentlist|disqus|replies|reply)(?:$|[-_\s\d])", re.I)
MAIN_NAME = re.compile(r"(?:^|\s)(?:(?:article|post|entry|story|page|main)[-_](?:body|content|text)|content|maincontent|articlebody|main)(?:$|\s)", re.I)
#: What an open element of the key's kind ends of the same list, up to its container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WITHIN = frozenset("ul ol dl table menu select body article section div".split())


#: An element's kind of chrome: not, by its class name only, and surely; BACK: an article inside what is chrome by name only.
BACK, PLAIN, NAMED, CHROME = -1, 0, 1, 2
#: What leaves an unclosed head open; anything else begins the body.
IN_HEAD = frozenset("html head meta link base basefont bgsound".split())


def kind_of(tag: str, attributes: str) -> tuple[int, int]:
    """(kind of chrome, how surely it holds the article: 0 to 3) of an element."""
    at = {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if attributes.strip(" /") else {}
    name = f"{at.get('class', '')} {at.get('id', '')}"
    role = at.get("role", "").lower()
    if "hidden" in at or at.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", at.get("style", ""), re.I):
        return CHROME, 0
    if tag in ("article", "main") or role in ("main", "article") or at.get("itemprop", "").lower() == "articlebody":
        comment = COMMENT_NAME.search(name) or at.get("itemprop", "").lower() == "comment"
        return CHROME if comment else PLAIN, 2 if tag == "main" or role == "main" else 3
    if tag in CHROME_TAGS or role in CHROME_ROLES:
        return CHROME, 0
    if tag in ("html", "body"):
        return PLAIN, 0
    if MAIN_NAME.search(name):
        return PLAIN, 1
    return NAMED if name.strip() and CHROME_NAME.search(name) else PLAIN, 0


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, surety) of the page's blocks that aren't surely chrome, in order.  The surety of
    blocks that are chrome by class name only is its complement, a negative number; they are left
    out beside an article."""
    found: list[tuple[str, int, int]] = []  # text, surety, kind
    stack: list[tuple[str, int, int]] = []  # tag, chrome, surety of the whole path
    count: Counter = Counter()
    text: list[str] = []
    at, page = 0, page or ""

    def flush() -> None:
        if text:
            if line := " ".join(html_lib.unescape("".join(text)).split()):
                found.append((line, *((stack[-1][2], stack[-1][1]) if stack else (0, PLAIN))))
            text.clear()

    def close(depth: int) -> None:
        if stack[-1][1:] != (stack[depth - 1][1:] if depth else (PLAIN, 0)):
            flush()  # an inline element ends no block
        while len(stack) > depth:
            count[stack.pop()[0]] -= 1

    def last(tags, within=frozenset()) -> int | None:
        if not any(count[t] for t in tags):
            return None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in within:
                return None
        return None

    while m := TOKEN.match(page, at):
        at = m.end()
        token, tag = m[0], (m[1] or "").lower()
        if count["head"] and (token[1:2] != "/" and tag not in IN_HEAD | RAW if tag else token[0] != "<" and stack[-1][0] == "head" and token.strip()):
            close(last({"head"}))
        chrome = stack[-1][1] if stack else PLAIN
        if not tag:
            if chrome <= NAMED and not token.startswith(("<!", "<?")):
                text.append(token)
            continue
        if token[1] == "/":
            if tag in BLOCK:
                flush()
            if count[tag]:
                close(last({tag}))
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS and (i := last(ENDS[tag], WITHIN)) is not None:
                close(i)
            elif tag not in ("br", "hr") and (i := last({"p"}, WITHIN)) is not None:
                close(i)
        if tag in VOID or token.endswith("/>") and tag not in BLOCK:
            continue
        drop, sure = kind_of(tag, m[2])
        if tag == "header" and not (stack and stack[-1][2] >= 2):
            drop = CHROME  # a header inside the article is the article's
        if drop or sure:
            flush()
        count[tag] += 1
        if CHROME in (chrome, drop):
            chrome = CHROME
        elif chrome == NAMED and sure >= 2:
            chrome = BACK
        else:
            chrome = drop or chrome
        stack.append((tag, chrome, max(sure, stack[-1][2] if stack else 0)))
    flush()
    if any(s >= 2 and kind == PLAIN for _, s, kind in found):  # then an article inside chrome is a teaser
        found = [x for x in found if x[2] != BACK]
    if any(s and kind != NAMED for _, s, kind in found):
        found = [x for x in found if x[2] != NAMED]
    return [(line, ~s if kind == NAMED else s) for line, s, kind in found]


def open_lines(found: list[tuple[str, int]]) -> list[str]:
    """The lines that say whether pages are equal: those that no class name speaks against, if there are any."""
    return [x for x, s in found if s >= 0] or [x for x, _ in found]


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, by bit rows."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    shared, a, b = set(range(n)), a[n:], b[n:]
    where: dict[str, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]  # a zero bit: the common subsequence grows at this place of b
    for line in a:
        v, u = rows[-1], rows[-1] & where.get(line, 0)
        rows.append((v + u | v - u) & full)
    length = lambda i, j: j - (rows[i] & (1 << j) - 1).bit_count()
    i, j = len(a), len(b)
    while i and j:
        if length(i, j) == length(i - 1, j):
            i -= 1
        elif length(i, j) == length(i, j - 1):
            j -= 1
        else:
            i, j = i - 1, j - 1
            shared.add(n + i)
    return shared


def address(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; port, user and a leading www. don't count, nor query and fragment."""
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?(?://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?)?([^?#]*)", url or "")
    return (m[1] or "").lower().removeprefix("www."), m[2].rstrip("/ ") or "/"


def nearness(path: str, other: str) -> int:
    n = 0
    for x, y in zip(path.split("/"), other.split("/")):
        if x != y:
            break
        n += 1
    return n


def main_text(found: list[tuple[str, int]], partner: list[tuple[str, int]] | None) -> tuple[str, int]:
    """(text, number of shared open lines) of a page from its blocks and its partner's."""
    best = max((s for _, s in found), default=0)
    text, shared = "", 0
    for named in (False, True):
        mine = [(x, s) for x, s in found if (s < 0) == named]
        gone = common_lines([x for x, _ in mine], [x for x, s in partner if (s < 0) == named]) if partner and mine else set()
        shared += len(gone)
        text = text or " ".join(x for i, (x, s) in enumerate(mine) if (named or s == best) and (best > 0 or i not in gone))
    return text, shared


LEAST = -(1 << 63)
KEY = ["host", "path", "page_id", "lines_hash"]
#: Characters of text that go out in one Arrow batch, if one text is not longer.
OUT_CHARS = 8 << 20


def beside(edges: list[list[dict]]) -> list[tuple[tuple | None, str, str, tuple | None]]:
    """For each run (key of the page before its first row of equal pages, path of that row's
    begin, path of the end of its last row, key of the page after it), wherever they lie.  A run is given
    by its outer rows of equal pages in order: all of them up to four, else the first two and
    the last two, each with what makes pages equal (same), first key and last key."""
    def walk(runs: list[list[dict]], near: str, far: str) -> list[tuple[tuple | None, str]]:
        out: list[tuple[tuple | None, str]] = []
        for r, rows in enumerate(runs):
            if not r:
                out.append((None, rows[0][far][1]))
            elif runs[r - 1][-1]["same"] != rows[0]["same"]:
                out.append((runs[r - 1][-1][near], rows[0][far][1]))
            elif len(runs[r - 1]) > 1:
                out.append((runs[r - 1][-2][near], runs[r - 1][-1][far][1]))
            else:
                out.append(out[-1])
        return out

    left = walk(edges, "last", "first")
    right = walk([rows[::-1] for rows in edges[::-1]], "first", "last")[::-1]
    return [(before, begin, end, after) for (before, begin), (after, end) in zip(left, right)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", n_runs: int | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars, then the page_id of its partner and the number of
    its open lines that the partner shares."""
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    place = lambda url, page_id: (*address(url), LEAST if pd.isna(page_id) else int(page_id))
    hashed = lambda found: hashlib.blake2b("\n".join(open_lines(found)).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()

    only = rows.select("page_id", "url")
    total = only.count()
    # a few runs a shuffle partition, of some hundred pages at least
    n_runs = n_runs or min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // 200 + 1)
    every = max(1, total // (n_runs * 50))
    sample = only.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(every)) == 0).distinct().collect()  # about 50 a run
    drawn = sorted({place(r["url"], r["page_id"]) for r in sample})
    splitters = sorted({drawn[len(drawn) * i // n_runs] for i in range(1, n_runs)}) if drawn else []

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(*place(u, i), hashed(blocks(h))) for i, u, h in zip(batch["page_id"].astype("Int64"), batch["url"], batch["html"])]
            yield pd.DataFrame([(bisect_right(splitters, k), *k) for k in found], columns=["run", *KEY])

    also: dict[tuple, list[int]] = {}
    ends: dict[int, tuple[str, str]] = {}
    if splitters:
        table = written(rows.mapInPandas(keys, "run int, host string, path string, page_id long, lines_hash string"), "html_keys")
        whole, in_order = Window.partitionBy("run"), Window.partitionBy("run").orderBy(*KEY)
        begins = F.coalesce((F.lag("host").over(in_order) != F.col("host")) | (F.lag("lines_hash").over(in_order) != F.col("lines_hash")), F.lit(True))
        equal = (table.withColumn("begins", begins).withColumn("row", F.sum(F.col("begins").cast("long")).over(in_order))
                 .groupBy("run", "row").agg(F.min(F.struct(*KEY)).alias("first"), F.max(F.struct(*KEY)).alias("last"))
                 .withColumn("n_rows", F.max("row").over(whole)).where("row <= 2 OR row >= n_rows - 1"))
        runs: dict[int, list[dict]] = {}
        for r in equal.orderBy("run", "row").collect():
            first, last = tuple(r["first"]), tuple(r["last"])
            runs.setdefault(r["run"], []).append({"same": (first[0], first[3]), "first": first, "last": last})
        for run, (before, begin, end, after) in zip(runs, beside(list(runs.values()))):
            ends[run] = begin, end
            for k in {before, after} - {None}:
                also.setdefault(k, []).append(run)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: set[tuple] = set()  # of a repeated row one copy does
        for batch in batches:
            out = []
            for page_id, url, page in zip(batch["page_id"].astype("Int64"), batch["url"], batch["html"]):
                found = blocks(page)
                k = (*place(url, page_id), hashed(found))
                row = (*k, url, [x for x, _ in found], [s for _, s in found])
                out.append((bisect_right(splitters, k), True, *row))
                if k in also and k not in sent:
                    sent.add(k)
                    out += [(run, False, *row) for run in also[k]]
            yield pd.DataFrame(out, columns=["run", "own", *KEY, "url", "lines", "sure"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks_of = lambda page: list(zip(page.lines, page.sure))
        name = lambda x: None if x is None or x.page_id == LEAST else x.page_id

        def told(before, row: list[tuple], kinds: dict[tuple, list], first, last, after) -> Iterator[tuple]:
            """The results of a row of equal pages between two others."""
            if not row:
                return
            begin, end = ends.get(first.run, (None, None))
            sides = [] if before is None else [(nearness(begin if begin is not None and not before.own else first.path, before.path), before)]
            sides += [] if after is None else [(nearness(end if end is not None and not after.own else last.path, after.path), after)]
            partner = max((x for x in sides if x[1].host == first.host), key=lambda x: x[0], default=(0, None))[1]  # the first of equals
            texts = {k: main_text(found, None if partner is None else blocks_of(partner)) for k, found in kinds.items()}
            for page_id, url, k in row:
                yield page_id, url, texts[k][0], len(texts[k][0]), name(partner), texts[k][1]

        def results() -> Iterator[tuple]:
            before, row, kinds, first, last = None, [], {}, None, None
            for batch in batches:
                for page in batch.itertuples(index=False):
                    if first is None or (page.run, page.host, page.lines_hash) != (first.run, first.host, first.lines_hash):
                        if first is not None:
                            yield from told(before, row, kinds, first, last, page if page.run == first.run else None)
                            before = last if page.run == first.run else None
                        first, row, kinds = page, [], {}
                    if page.own:
                        kind = (tuple(page.sure), *(x for x, s in blocks_of(page) if s < 0))  # equal pages of other markup
                        if kind not in kinds:
                            kinds[kind] = blocks_of(page)
                        row.append((name(page), page.url, kind))
                    last = page
            if first is not None:
                yield from told(before, row, kinds, first, last, None)

        out, size = [], 0
        for x in results():
            out.append(x)
            size += len(x[2]) + 100
            if size >= OUT_CHARS:
                yield _named(out)
                out, size = [], 0
        yield _named(out)

    schema = "run int, own boolean, host string, path string, page_id long, lines_hash string, url string, lines array<string>, sure array<int>"
    ordered = rows.mapInPandas(parse, schema).repartition(n_runs, "run").sortWithinPartitions("run", *KEY, "own")
    return ordered.mapInPandas(compare, "page_id long, url string, text string, n_chars long, partner_id long, n_shared_lines long")


def _named(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "text", "n_chars", "partner_id", "n_shared_lines"])
    return out.assign(page_id=out["page_id"].astype("Int64"), partner_id=out["partner_id"].astype("Int64"))
