"""Main text of web pages by differencing with the nearest page of the host (operator 7)."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm._scratch import stored
from fleetlens.llm.urls import host_of, path_of

PART_BYTES = 2 << 20
#: Elements that break a line, that hold no running text, and names of page furniture.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("aside button canvas dialog footer form head header iframe menu nav noscript object script search select style svg template textarea title".split())
RAW = frozenset("script style template textarea noscript iframe title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = re.compile(r"ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|menu|nav|navbar|navigation|newsletter|notices?|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget")
#: Parts of a name that say what kind of box it is, and parts that say that a page has or lacks something.
BOXES = frozenset("area articles bar block bottom box btn button buttons container cta form group icon icons inner item items left link links list media outer panel posts primary right row secondary section signup slot stories this toggle top unit widgets wrap wrapper".split())
MODIFIERS = frozenset("has with no without not hide show".split())
OWNERS = frozenset("article author blog entry google page post reader site story user visitor".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())

_START = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?])")
#: What follows a tag's name up to its end; quotes count behind an equals sign. Possessive, so that nothing is tried twice.
_REST = re.compile(r"""((?:[^>="']++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
_LONG_NUMBER = re.compile(r"&#0*(?:([1-9][0-9]{7,})|0{8,}(?=[0-9]?));?")
_ATTRIBUTE = re.compile(r"(?i)\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
_SPACES = re.compile(r"\s+")


def _names_furniture(attribute: str, value: str, article: bool) -> bool:
    """Whether a class, id or role is one of page furniture; in an article a header holds its heading.

    A class or id counts if it is such a name as a whole or ends in one, less the parts of BOXES and numbers at its end. In an
    article all its parts must be such names or say whose they are: market-share and release-notice are what the article is about.
    """
    value = value.lower()
    if attribute.lower() == "role":
        return value in ROLES
    for token in value.split():
        parts = [x for x in re.split(r"[-_]", token.split("--")[0]) if x]
        if not parts or not MODIFIERS.isdisjoint(parts):
            continue
        while len(parts) > 1 and (parts[-1] in BOXES or parts[-1].isdigit()):
            parts.pop()
        if FURNITURE.fullmatch(parts[-1]) and not (article and (parts[-1] == "header" or any(x not in OWNERS and x not in BOXES and not FURNITURE.fullmatch(x) for x in parts[:-1]))):
            return True
    return False


def all_lines(page: str) -> list[tuple[str, bool, bool]]:
    """(line, within the article, furniture) for each block of text, page furniture too, but no script, style, title or comment.

    A line is the text between two block borders, character references decoded, white space made one space. Furniture is what
    lies in elements of DROPPED, or whose class, id or role names one. Inside of an article only blocks
    count by their names, never what stands in a line. A form and a named element stay if they hold an article or main element, or more than half of the page's text while no article or main element stands elsewhere (else a long advert
    beside a short article would stay); what is named inside is judged by itself. The end tag of an element also ends what is
    open inside. A tag or comment that never ends takes the rest of the page. Time is linear in the page, whatever it holds; aligning its lines (see common_lines()) is not.
    """
    lines: list[tuple[list[tuple[str, int, bool]], bool]] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, furniture, article, innermost named element
    where: dict[str, list[int]] = {}  # places of each name in the stack
    borders = [-1]  # and of what a paragraph does not reach across
    parts: list[tuple[str, int, bool]] = []
    # of each named element: the one around it, whether it holds an article, stands in one, characters; 0 is the page
    outer, holds, within, size = [0], [True], [False], [0]
    marked = False
    furniture = article = False
    inside = 0

    def flush() -> None:
        nonlocal parts
        if parts:
            lines.append((parts, article))
            parts = []

    def add(text: str) -> None:
        parts.append((text, inside, furniture))
        if not furniture:
            size[inside] += len(text.strip())

    def close(i: int) -> tuple[bool, bool, int]:
        for name, *_ in stack[i:]:
            where[name].pop()
        del stack[i:]
        while borders[-1] >= i:
            borders.pop()
        return stack[-1][1:] if stack else (False, False, 0)

    at = 0
    while m := _START.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        name = (m[3] or "").lower()
        if not name:
            end = page.find("-->" if m[1] else ">", m.end() - (2 if m[1] else 0))
            at = end + (3 if m[1] else 1) if end >= 0 else len(page)
            continue
        rest = _REST.match(page, m.end())
        if not rest:
            at = len(page)
            break
        at = rest.end()
        if name in BLOCKS or name in DROPPED:
            flush()
        elif name == "br":
            parts.append((" ", inside, furniture))
        if m[2]:
            if where.get(name):
                furniture, article, inside = close(where[name][-1])
        elif name not in VOID and not rest[1].endswith("/"):
            if name in ("p", "li", "dd", "dt", "tr", "td", "th", "option") and where.get(name) and where[name][-1] > borders[-1]:  # these end an open one of their kind
                furniture, article, inside = close(where[name][-1])
            marks = _ATTRIBUTE.findall(rest[1]) if rest[1] else ()
            named = name not in ("html", "body", "main", "article") and (name in BLOCKS or not article) and any(_names_furniture(k, v.strip("\"'"), article) for k, v in marks)
            furniture = furniture or (name in DROPPED and name != "form" and not (name == "header" and article))
            if not furniture and name in ("article", "main"):
                article, marked, i = True, True, inside
                while not holds[i]:
                    holds[i], i = True, outer[i]
            if not furniture and (named or name == "form"):
                outer.append(inside)
                holds.append(False)
                within.append(article)
                size.append(0)
                inside = len(outer) - 1
            where.setdefault(name, []).append(len(stack))
            if name in BLOCKS and name not in ("p", "td", "th", "li", "dd", "dt", "tr", "option"):
                borders.append(len(stack))
            stack.append((name, furniture, article, inside))
            if name in RAW:
                end = re.compile(rf"</{name}[\s>/]", re.I).search(page, at)
                at = end.start() if end else len(page)
    if at < len(page):
        add(page[at:])
    flush()
    for i in range(len(outer) - 1, 0, -1):
        size[outer[i]] += size[i]
    kept = [True]
    for i in range(1, len(outer)):
        kept.append(kept[outer[i]] and (holds[i] or ((within[i] or not marked) and 2 * size[i] > size[0])))
    out = []
    for pieces, is_article in lines:
        for other in (False, True):
            text = _plain("".join(x for x, i, f in pieces if (f or not kept[i]) == other))
            if text:
                out.append((text, is_article, other))
    return out


def _plain(text: str) -> str:
    """Character references decoded and white space made one space."""
    if "&#" in text:
        text = _LONG_NUMBER.sub(lambda m: "\ufffd" if m[1] else "&#0", text)
    return _SPACES.sub(" ", html.unescape(text)).strip()


def page_lines(page: str) -> list[tuple[str, bool]]:
    """(line, within the article) for each block of text outside of page furniture: see all_lines()."""
    return [(x, article) for x, article, furniture in all_lines(page) if not furniture]


class _Places:
    """The places of each line of a list as bits of an integer; a line with few places has them made when they are asked for."""

    def __init__(self, lines: list[str]):
        self.at: dict[str, list[int]] = {}
        for j, x in enumerate(lines):
            self.at.setdefault(x, []).append(j)
        self.bytes = len(lines) // 8 + 1
        self.many: dict[str, int] = {}

    def of(self, line: str) -> int:
        at = self.at.get(line, ())
        if len(at) < 2:
            return 1 << at[0] if at else 0
        if line in self.many:
            return self.many[line]
        bits = bytearray(self.bytes)
        for j in at:
            bits[j >> 3] |= 1 << (j & 7)
        found = int.from_bytes(bits, "little")
        if len(at) >= 256:
            self.many[line] = found
        return found


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence with b, by rows of bits held in integers.

    Of all rows one in about sqrt(len(a)) is kept; those between are computed again when the way back comes by.
    """
    places, full = _Places(b), (1 << len(b)) - 1
    step = max(1, int(len(a) ** 0.5))

    def rows_from(row: int, first: int, last: int) -> Iterator[int]:
        for x in a[first:last]:
            hit = row & places.of(x)
            row = ((row + hit) | (row - hit)) & full
            yield row

    kept = [full]  # before line 0, step, 2 * step ...
    for i, row in enumerate(rows_from(full, 0, len(a)), 1):
        if i % step == 0:
            kept.append(row)
    found, j = set(), len(b)
    for k in range(len(kept) - 1, -1, -1):
        rows = [kept[k], *rows_from(kept[k], k * step, min(len(a), (k + 1) * step))]
        for i in range(len(rows) - 1, 0, -1):  # a row's zero bits are where the length steps up
            while j and rows[i] >> (j - 1) & 1:
                j -= 1
            if not j:
                return found
            if rows[i - 1] >> (j - 1) & 1:  # the step at j is new in row i
                found.add(k * step + i - 1)
                j -= 1
    return found


def main_text(lines: list[tuple[str, bool]], neighbour: list[tuple[str, bool]] | None) -> str:
    """All lines less those outside of an article or main element that the neighbour has outside of one too, in the same order."""
    return differenced([(x, article, False) for x, article in lines], None if neighbour is None else [x for x, article in neighbour if not article])[0]


def differenced(lines: list[tuple[str, bool, bool]], outside: list[str] | None) -> tuple[str, int]:
    """The text of the lines less furniture and less what stands outside of an article and is shared, in order, with a neighbour's such lines; and how many are shared."""
    own = [i for i, (_, article, _) in enumerate(lines) if not article]
    shared = {own[i] for i in common_lines([lines[i][0] for i in own], outside)} if outside else set()
    return "\n\n".join(x for i, (x, _, furniture) in enumerate(lines) if not furniture and i not in shared), len(shared)


def _digest(lines: list[tuple[str, bool]]) -> int | None:
    """A number for the lines of a page, None where it has none."""
    if not lines:
        return None
    return int.from_bytes(hashlib.blake2b("\n".join(x for x, _ in lines).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _likeness(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about PART_BYTES, as Python's strings take several times the room of Arrow's."""
    step = max(1, int(batch.num_rows * PART_BYTES / max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


#: A page as its lines within its article and outside; marks has a byte for each in order (1: article, 2: furniture), digest is null where nothing but furniture stands.
PARSED = "id {}, url string, host string, path string, tie long, digest long, inside array<string>, outside array<string>, marks binary"
_PAGE = "struct<path: string, tie: long, digest: long>"
_EDGE = f"pid int, side string, host string, page {_PAGE}, other {_PAGE}"
_NEAR = "host string, path string, tie long, partner_path string, partner_tie long"
_TYPE = pa.struct([("path", pa.string()), ("tie", pa.int64()), ("digest", pa.int64())])


def nearest(hosts: list, paths: list, ties: list, digests: list, before: dict | None = None, after: dict | None = None) -> list[tuple]:
    """For pages in order of (host, path, tie): the nearest before and after of the same host with another digest, as (path, tie, digest) or None.

    before is the last page ahead of these, after the first one behind them, each with its host and the nearest other page beyond.
    """
    out = []
    for walk, edge in ((range(len(hosts)), before), (range(len(hosts) - 1, -1, -1), after)):
        found = [None] * len(hosts)
        host, last, other = (edge["host"], edge["page"], edge["other"]) if edge else (None, None, None)
        for i in walk:
            if hosts[i] != host:
                host, last, other = hosts[i], None, None
            if last is not None and last[2] != digests[i]:
                other = last
            found[i], last = other, (paths[i], ties[i], digests[i])
        out.append(found)
    return list(zip(*out, strict=True))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group_bytes: int = 8 << 20) -> DataFrame:
    """(id, url, text, n_chars, n_shared): the main text of each whole page; blocks are joined by two line feeds.

    Method. Pages of a host are paired by path: in the order of paths each page is compared with the next page before or after it
    that has other lines (copies and empty pages are passed over), the one whose path has the longer start in common. All lines
    that stand outside of an article or main element, menus, headers and footers as well as the rest, are aligned with the
    neighbour's by a longest common subsequence, and shared lines are deleted; n_shared tells how many. What a page's own marks
    name as menus, headers, footers, sidebars, notices, adverts, forms and comments goes too, as such lines often differ from page
    to page. Lines in an article or main element always stay, so that pages with the same passage in their articles keep it.

    Neighbours are found on keys alone (host, path, digest), sorted over all hosts in slices of about group_bytes; of the pages at
    a slice's edges, and of the nearest other page beyond them, the next slice knows the keys, so the size of slices changes no
    result and a host may hold all pages. Only the lines outside of articles, which are few, are written on the way; they are joined
    to the pages, which are parsed a second time, so that whole pages are on disk in one shuffle only.

    Null html is an empty page with empty text. A null or bad url counts as an empty host and path. Rows that repeat are pages
    of their own. Empty tables give no rows; other columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.xxhash64(id_col, html_col).alias("tie"), F.col(html_col).alias("html"))
    kind = pages.schema[id_col].dataType.simpleString()

    def parse(batches):
        for b in (part for whole in batches for part in _parts(whole)):
            lines = [all_lines(x) if x else [] for x in b.column("html").to_pylist()]
            digests = [_digest([(x, article) for x, article, furniture in page if not furniture]) for page in lines]
            part = lambda inside: pa.array([[x for x, article, _ in page if article == inside] for page in lines], pa.list_(pa.string()))  # noqa: E731, B023
            marks = pa.array([bytes(article + 2 * furniture for _, article, furniture in page) for page in lines], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "url", "host", "path", "tie")), pa.array(digests, pa.int64()), part(True), part(False), marks], names=["id", "url", "host", "path", "tie", "digest", "inside", "outside", "marks"])

    parsed = rows.mapInArrow(parse, PARSED.format(kind))
    key = ["host", "path", "tie"]
    full = stored(parsed.where("digest is not null").select(*key, "digest", "outside"), "outside-lines")
    size = full.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 24), F.count("*")).first()
    slices = max(-(-(size[0] or 0) // group_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size[1] // 1024)), 1)
    keys = full.select(*key, "digest").distinct().repartitionByRange(slices, *key)
    keys = stored(keys.select(F.spark_partition_id().alias("pid"), *key, "digest"), "page-keys")  # a slice's number holds as it is written once

    def columns(table: pa.Table) -> list[list]:
        table = table.sort_by([(c, "ascending") for c in key])
        return [table[c].to_pylist() for c in (*key, "digest")]

    def edges(table: pa.Table) -> pa.Table:
        host, path, tie, digest = columns(table)
        near, pid, names = nearest(host, path, tie, digest), table["pid"][0].as_py(), ("path", "tie", "digest")
        ends = [("head", 0, near[0][1]), ("tail", len(host) - 1, near[-1][0])]
        return pa.table({
            "pid": pa.array([pid] * 2, pa.int32()), "side": [side for side, _, _ in ends], "host": pa.array([host[i] for _, i, _ in ends], pa.string()),
            "page": pa.array([dict(zip(names, (path[i], tie[i], digest[i]), strict=True)) for _, i, _ in ends], _TYPE), "other": pa.array([x and dict(zip(names, x, strict=True)) for _, _, x in ends], _TYPE),
        })

    # two rows for each slice: its first and last page, with the nearest other page of the host in the slice and then beyond it
    ends = stored(keys.groupBy("pid").applyInArrow(edges, _EDGE), "slice-edges")
    beyond = None
    for side, order in (("tail", [F.col("pid"), F.col("side")]), ("head", [F.desc("pid"), F.desc("side")])):
        w = Window.partitionBy("host").orderBy(*order)
        last = F.lag("page").over(Window.partitionBy("host", "side").orderBy(*order))
        x = ends.withColumn("_near", F.coalesce("other", F.when(last["digest"] != F.col("page.digest"), last)))
        x = x.withColumn("other", F.last(F.when(F.col("side") == side, F.col("_near")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        x = x.withColumn("_lent", F.last(F.when(F.col("side") == side, F.struct("page", "other")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        x = x.where((F.col("side") != side) & F.col("_lent").isNotNull()).select("pid", "side", "host", "_lent.page", "_lent.other")
        beyond = x if beyond is None else beyond.unionByName(x)

    def partners(table: pa.Table, lent: pa.Table) -> pa.Table:
        host, path, tie, digest = columns(table)
        known = {r["side"]: {"host": r["host"], **{k: r[k] and tuple(r[k].values()) for k in ("page", "other")}} for r in lent.to_pylist()}
        best = [max((x for x in pair if x), key=lambda x: _likeness(path[i], x[0]), default=None) for i, pair in enumerate(nearest(host, path, tie, digest, known.get("head"), known.get("tail")))]  # noqa: B023
        at = [i for i, x in enumerate(best) if x]
        take = lambda c: [c[i] for i in at]
        return pa.table({"host": pa.array(take(host), pa.string()), "path": pa.array(take(path), pa.string()), "tie": pa.array(take(tie), pa.int64()), "partner_path": pa.array([best[i][0] for i in at], pa.string()), "partner_tie": pa.array([best[i][1] for i in at], pa.int64())})

    near = stored(keys.groupBy("pid").cogroup(beyond.groupBy("pid")).applyInArrow(partners, _NEAR), "neighbours")
    lines = full.groupBy(*key).agg(F.first("outside").alias("_other")).where(F.size("_other") > 0).select("host", F.col("path").alias("partner_path"), F.col("tie").alias("partner_tie"), "_other")
    near = near.join(lines, ["host", "partner_path", "partner_tie"]).select(*key, "_other")
    joined = parsed.join(near, key, "left").select("id", "url", "inside", "outside", "marks", "_other")

    def difference(batches):
        for b in (part for whole in batches for part in _parts(whole)):
            out = []
            for inside, outside, marks, other in zip(*(b.column(c).to_pylist() for c in ("inside", "outside", "marks", "_other")), strict=True):
                parts = (iter(outside), iter(inside))
                out.append(differenced([(next(parts[m & 1]), bool(m & 1), bool(m & 2)) for m in marks], other))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array([x for x, _ in out], pa.string()), pa.array([len(x) for x, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64())], names=["id", "url", "text", "n_chars", "n_shared"])

    done = joined.mapInArrow(difference, f"id {kind}, url string, text string, n_chars long, n_shared long")
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars", "n_shared")
