"""HTML main text by equivalence-class template deduction.

Pages of one host are instances of a template. A page's tokens are its tags, told apart by their path
from the root (names and classes), and its text blocks, told apart by path and content. For each host
every token has an occurrence vector: how often each page holds it. Tokens of equal vector form an
equivalence class. Vectors are never gathered: a token's vector is named by the sum, over the pages,
of a hash of page and count together, with the number of pages, which partial aggregates build over all pages.

A class is valid when it spans enough pages of the host, holds a tag, is ordered and nests. Ordered: its
tokens come round in one order on every page, each as often as any other; a token that changes its place
breaks off. Nested: from its first token to its last, a round lies within one gap of another class's round,
holds it in one of its own or stands apart from it; of two classes that cross on any page the one of fewer
pages (then of fewer tokens, then of the smaller name) is dropped. Pages are parsed once; their tokens, those
of an article's text too, are written and read for vectors, order and nesting. The tokens of valid classes are the template. Which region holds the text is judged page by
page: an article or main element if the page has one, else the body, without menus, headers, footers,
sidebars, notices, adverts, forms or comments, by the names and attributes on an element's own path.
The template decides on the text blocks of a page without article: those in it are no text. An article is given whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefold.llm import common as C

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                 r"<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)", re.S)   # a quote counts as a value's first character only
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]+))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math title select option button".split())
VOID_INLINE = frozenset("wbr img input embed".split())         # neither white space nor the end of a block
SWALLOWS = frozenset("script style textarea iframe".split())    # without an end tag they hold the rest of the page
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
ARTICLE = frozenset({"article", "main"})
AROUND = frozenset("nav header footer aside form script style noscript template textarea iframe svg math title head select option button dialog menu figure-nav".split())
WHOLE = frozenset({"html", "body", "article", "main"})        # not judged by class, id or role
WORDS = re.compile(r"nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|related|recommended|ads?|advert|advertisement|adverts|"
                   r"sponsor|sponsored|promo|banner|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|share|social|comments?|"
                   r"comment-list|disqus|replies|reply|login|search|pagination|pager|widget|copyright")
ROOT = ("", b"", False, False)
UNSEEN = re.compile(r"(?:^|;)display:none(?:$|[;!])")
SPACES = re.compile(r"\s+")
PAGES_SHARE = 0.5             # of a host's pages that a valid class spans at least
MIN_PAGES = 3                 # of a host before its text blocks can be template
FLUSH = 1 << 20               # tokens gathered in a task before they are sent on


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def pairs_of(attributes: str) -> dict[str, str]:
    """Names and values of a tag's attributes in lower case; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        value = m.group(2) or ""
        out.setdefault(m.group(1).lower(), html.unescape(value.strip(value[0]) if value[:1] in ("'", '"') else value).lower())
    return out


def around(name: str, attributes: str) -> bool:
    """Whether an element is not part of the article, by its name, whole words of class, id or role, or as not shown."""
    if name in AROUND:
        return True
    if not attributes or name in ("html", "body"):
        return False
    have = pairs_of(attributes)
    if name not in WHOLE and any(WORDS.fullmatch(word) for what in ("class", "id", "role") for word in have.get(what, "").split()):
        return True
    return "hidden" in have or UNSEEN.search(SPACES.sub("", have.get("style", ""))) is not None


def signature(name: str, attributes: str) -> str:
    have = pairs_of(attributes) if attributes else {}
    return name + "." + have["class"] if "class" in have else name


def parse(page: str):
    """Events of a page: ("open", path, outside, name) for a tag, ("text", path, outside, in article, block text).

    A path is a hash of the signatures from the root, so that an open element takes the same memory at any depth.
    Block elements and <br> end a text block; entities are decoded and white space becomes one space. The tag of an element
    whose text is not read (a button, say) counts for nothing if no end tag follows; a title ends at the next tag then.
    """
    stack: list[tuple[str, bytes, bool, bool]] = []     # name, path, outside, in article
    count: Counter[str] = Counter()                     # open elements by name
    endless: set[str] = set()                           # names without an end tag in the rest of the page
    held: list[str] = []
    pos, n = 0, len(page)

    def block():
        text = SPACES.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            top = stack[-1] if stack else ROOT
            return ("text", top[1], top[2], top[3], text)
        return None

    def cut(i):
        count.subtract(x[0] for x in stack[i:])
        del stack[i:]

    while pos <= n:
        m = TAG.search(page, pos)
        if m is None:
            held.append(page[pos:])
            break
        held.append(page[pos:m.start()])
        pos = m.end()
        name = (m.group(2) or "").lower()
        if not name:                                     # comment, doctype or the like
            continue
        if name in VOID_INLINE:
            continue
        if name not in INLINE or (not m.group(1) and around(name, m.group(3))):
            event = block()
            if event:
                yield event
        if m.group(1):                                   # a closing tag closes what it finds open
            for i in range(len(stack) - 1, -1, -1) if count[name] else ():
                if stack[i][0] == name:
                    if name in INLINE and any(x[2] != stack[i][2] for x in stack[i:]):
                        event = block()
                        if event:
                            yield event
                    cut(i)
                    break
            continue
        empty = m.group(3).rstrip().endswith("/")
        if name in RAW and name not in endless and not (empty and name in ("svg", "math")):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, pos)
            if end or name in SWALLOWS:
                pos = end.end() if end else n
                continue
            endless.add(name)
        if name == "title":
            pos = page.find("<", pos) % (n + 1)
        if name in VOID or name in RAW:
            continue
        if name == "body" and count["head"]:             # the body ends a head that is still open
            cut(next(i for i, x in enumerate(stack) if x[0] == "head"))
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and count[name]:
            for i in range(len(stack) - 1, -1, -1):      # these close an open one of their kind in the same parent
                if stack[i][0] == name or name == "p" and stack[i][0] in INLINE:
                    if stack[i][0] == name:
                        cut(i)
                        break
                    continue
                break
        top = stack[-1] if stack else ROOT
        outside = top[2] or around(name, m.group(3)) and not (name == "header" and top[3])
        path = blake2b(top[1] + signature(name, m.group(3)).encode("utf-8", "replace"), digest_size=8).digest()
        if empty and name not in INLINE and name not in ("p", "div", "article", "main", "section", "body", "html"):
            continue
        stack.append((name, path, outside, top[3] or name in ARTICLE))
        count[name] += 1
        if name not in INLINE:
            yield ("open", path, outside, name)
    event = block()
    if event:
        yield event


def key(event) -> int:
    """A token's hash: path for a tag, path and content for a text block."""
    if event[0] == "open":
        return int.from_bytes(event[1], "big") >> 1
    return int.from_bytes(blake2b(event[1] + event[4].encode("utf-8", "replace"), digest_size=8, person=b"text").digest(), "big") >> 1


def named(page: int, n: int) -> int:
    """32 bits of a hash of a page and a count in which neither adds to the other."""
    x = (page * 0x9E3779B97F4A7C15 + n * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return x >> 32


def parsed(pages: DataFrame) -> DataFrame:
    """Pages (page_id, host, html, ...) with ``tokens`` in page order (of a text block: -1 - hash), ``text`` of the article (null without
    one) and the ``loose`` text blocks of a page without article, instead of ``html``."""
    kept = [c for c in pages.columns if c != "html"]

    def read(batches):
        for batch in batches:
            others = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            bodies = batch.column(batch.schema.get_field_index("html"))
            tokens, texts, loose, start, held = [], [], [], 0, 0
            for row, body in enumerate(bodies, 1):
                seen, inside, out, article = [], [], [], False
                for event in parse(body.as_py() or ""):
                    if event[0] == "open":
                        seen.append(key(event))
                        article = article or not event[2] and event[3] in ARTICLE
                        continue
                    seen.append(-1 - key(event))
                    if event[2]:                                     # a slot of a menu, notice or the like
                        continue
                    if event[3]:
                        inside.append(event[4])
                    else:
                        out.append({"token": seen[-1], "text": event[4]})
                tokens.append(seen)
                texts.append(" ".join(inside) if article else None)
                loose.append([] if article else out)
                held += len(seen)
                if held >= FLUSH or row == len(bodies):
                    yield pa.RecordBatch.from_arrays(
                        [c.slice(start, row - start) for c in others] + [pa.array(tokens, pa.list_(pa.int64())), pa.array(texts, pa.string()),
                                                                         pa.array(loose, pa.list_(pa.struct([("token", pa.int64()), ("text", pa.string())])))],
                        [*kept, "tokens", "text", "loose"])
                    tokens, texts, loose, start, held = [], [], [], row, 0

    types = dict(pages.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + ["tokens array<long>, text string, loose array<struct<token:long,text:string>>"])
    return pages.mapInArrow(read, schema)


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, is_text, vector, pages): named occurrence vectors over all pages of each host."""
    def count(batches):
        for batch in batches:
            sums: dict[tuple[str, int], list] = {}
            for page_id, host, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                seen = Counter(tokens.as_py())
                names = {n: named(page_id or 0, n) for n in set(seen.values())}
                for token, n in seen.items():
                    entry = sums.setdefault((host, token), [0, 0])
                    entry[0] += names[n]
                    entry[1] += 1
            rows = list(sums.items())
            for lo in range(0, len(rows), 20_000):
                part = rows[lo:lo + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0][0] for r in part], pa.string()), pa.array([r[0][1] for r in part], pa.int64()),
                     pa.array([r[1][0] for r in part], pa.int64()), pa.array([r[1][1] for r in part], pa.int64())], ["host", "token", "vector", "pages"])

    if "tokens" not in pages.columns:
        pages = parsed(pages)
    counted = pages.select("page_id", "host", "tokens").mapInArrow(count, "host string, token long, vector long, pages long")
    return counted.groupBy("host", "token").agg(F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"), F.sum("pages").alias("pages")).select(
        "host", "token", (F.col("token") < 0).alias("is_text"), "vector", "pages")


def _by_host(members: DataFrame) -> DataFrame:
    """(host, members): each host's tokens with the class that they belong to."""
    return members.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("token", "class", "pages"))).alias("members"))


def _sweep(pages: DataFrame, members: DataFrame, judge, schema: str) -> DataFrame:
    """``judge(tokens, of, size)`` of every page: ``of`` a token's (class, pages), ``size`` a class's number of tokens; its rows with the host before."""
    def run(batches):
        for batch in batches:
            found: dict[tuple, list] = {}
            known: dict[str, tuple] = {}
            for host, tokens, of in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if host not in known:
                    mine = {m["token"]: (m["class"], m["pages"]) for m in of.as_py()}
                    known[host] = mine, Counter(c for c, _ in mine.values())
                for what, low, high in judge(tokens.as_py(), *known[host]):
                    entry = found.setdefault((host, what), [low, high])
                    entry[0], entry[1] = min(entry[0], low), max(entry[1], high)
            rows = list(found.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0][0] for r in rows], pa.string()), pa.array([r[0][1] for r in rows], pa.int64()),
                 pa.array([r[1][0] for r in rows], pa.int64()), pa.array([r[1][1] for r in rows], pa.int64())], schema.split(","))

    host, what, low, high = schema.split(",")
    out = pages.join(_by_host(members), "host").select("host", "tokens", "members").mapInArrow(run, f"{host} string, {what} long, {low} long, {high} long")
    return out.groupBy(host, what).agg(F.min(low).alias(low), F.max(high).alias(high))


def places(tokens: list[int], of: dict, size: dict):
    """(token, least, greatest place in its class's round) on one page; one place is what order asks for."""
    turn: Counter[int] = Counter()
    found: dict[int, tuple[int, int]] = {}
    for token in tokens:
        if token in of:
            c = of[token][0]
            place = turn[c] % size[c]
            turn[c] += 1
            low, high = found.get(token, (place, place))
            found[token] = min(low, place), max(high, place)
    return [(token, low, high) for token, (low, high) in found.items()]


def crossings(tokens: list[int], of: dict, size: dict):
    """(class, 1, 1) of each ordered class that crosses a wider one on one page."""
    turn: Counter[int] = Counter()
    lost: set[int] = set()
    stack: list[tuple[int, int, int]] = []              # open rounds: pages, tokens, class
    for token in tokens:
        if token not in of:
            continue
        c, pages = of[token]
        if c in lost or size[c] == 1:
            continue
        me = (pages, size[c], c)
        place = turn[c] % size[c]
        turn[c] += 1
        if place == 0:
            stack.append(me)
            continue
        while stack[-1] != me:                          # a round that began in this gap has not ended in it
            loser = min(stack[-1], me)
            lost.add(loser[2])
            stack.remove(loser)
            if loser == me:
                break
        else:
            if place == size[c] - 1:
                stack.pop()
    return [(c, 1, 1) for c in lost]


def templates(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """(host, template): hashes of the tokens of each host's valid classes, ordered and nested ones, from its pages' ``tokens``."""
    hosts = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    wide = F.col("pages") >= F.greatest(F.lit(1), F.ceil(F.col("host_pages") * PAGES_SHARE))
    name = F.xxhash64("vector", "pages").alias("class")
    # a text block must recur over several pages
    members = tokens.join(hosts, "host").where(wide).where(~F.col("is_text") | (F.col("host_pages") >= MIN_PAGES)).select("host", "token", "pages", name)
    members = C.written(_tagged(members), "html-classes")
    placed = _sweep(pages, members, places, "host,token,low,high").where("low = high").select("host", "token")
    ordered = C.written(_tagged(members.join(placed, ["host", "token"])), "html-ordered")
    crossing = _sweep(pages, ordered, crossings, "host,class,low,high").select("host", "class")
    nested = ordered.join(crossing, ["host", "class"], "left_anti")
    return nested.groupBy("host").agg(F.sort_array(F.collect_set("token")).alias("template"))     # at most 1 / PAGES_SHARE pages' tokens


def _tagged(members: DataFrame) -> DataFrame:
    """Members of classes that hold a tag to hang their text blocks on."""
    tagged = members.where("token >= 0").select("host", "class").distinct()
    return members.join(tagged, ["host", "class"], "left_semi")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html, ...).

    ``text``: the article's blocks, white space inside a block as one space, joined by one space in
    page order; empty if there are none, and for a null html. A page without an article or main
    element gives its body's blocks outside menus and the like. A null or odd url is a host of its
    own. Rows that repeat a page_id, or have none, are extracted like any other; other columns are
    ignored; an empty table gives an empty result.
    """
    C.prepared(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), host_of(F.col("url")).alias("host"), F.col("html"))
    read = C.written(parsed(rows), "html-tokens")
    found = C.written(templates(occurrences(read), read), "html-templates")
    # what is template outside the article is no slot
    slots = F.filter("loose", lambda x: ~F.coalesce(F.array_contains("template", x["token"]), F.lit(False)))
    text = F.coalesce("text", F.array_join(F.transform(slots, lambda x: x["text"]), " "))
    return read.join(found, "host", "left").select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
