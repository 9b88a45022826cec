"""Main text of HTML pages by equivalence classes of tokens.

A page's tokens are its block elements, told apart by their path, and its texts, told apart by path and words. Over all different pages of a
host that have text, tokens that occur equally often on each page, zeros included, form a class: an exclusive or of hashes of (page, count)
stands for the vector, so the counts are aggregated before they are shuffled. A class counts if it is on LEAST pages and a share of SHARE of
the host's pages. It is valid if its tokens come in one order on all pages that have it: in rounds within one gap between the tokens that come once, or
after the same of these. Valid classes nest in one another as their elements do, and are the template.

Texts of valid classes are template text. The containers of valid classes that come once on their pages are the template's slots. What a slot
holds besides template text is summed over the host's pages; words of links count against it. The article's slot is the innermost one that holds
MAIN of the host's sum: all text in it is the article, but for what its names set apart further inside, and for inner slots that are made of
links. Text in a slot beside it is not; text in no slot but those around it is judged by names, and so are pages without the article's slot.

Names are element names and the words of class, id and role. They weigh what a slot holds (a part that is named as no article counts ABOUT times less), and
they alone decide for hosts of fewer than LEAST different pages with text: the article is then what is in article elements, else in main
elements or in others that are called so, else all that no name sets apart. A class or id sets apart only if it is made of such words and NEUTRAL ones.

Character references are decoded, white space in a block becomes one space, blocks are joined by a line break. Null and empty pages give
an empty text; so do pages without an article. Null urls are one host. Unclosed and stray tags are handled as browsers do for the
elements named here. Copies of a page count once for the classes and get the same text. Rows may repeat; other columns are
ignored; an input without rows gives none. Neither partitions nor the order of rows change a text.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeq.llm.base import by_batch, stored, table

LEAST, SHARE, PART_ROWS = 8, 0.2, 2000
#: The share of a host's text that its article's slot holds, how much less text counts that is named as no article, and the share of links of a menu.
MAIN, ABOUT, LINKS = 0.6, 10, 0.7
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title|noscript|iframe|template|svg|math|xmp)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.DOTALL | re.IGNORECASE)
NAMED = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption option optgroup html body".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
APART = frozenset("nav aside footer form head menu button select dialog object applet canvas audio video datalist".split())
OUTSIDE = frozenset(["header"])
APART_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion notice cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login comment comments disqus replies reply respond discussion feedback share sharing social related recommended recommendations pagination pager skip toolbar complementary contentinfo search masthead".split())
OUTSIDE_WORDS = frozenset("header head top topbar alert message".split())
MAIN_WORDS = frozenset("main article content post entry story".split())
#: Words that change nothing beside words that set apart.
NEUTRAL = frozenset("area bar block body box btn button buttons col column container content footer form group header icon icons inner item items js left link links list main module page panel post posts primary right row secondary section site text title top bottom wrap wrapper".split())
#: Elements that can be slots.
CONTAINERS = frozenset("article aside body center details dialog div dl fieldset figure footer form header hgroup html main menu nav ol section table tbody td th tr ul".split())


class Block(NamedTuple):
    text: str
    key: int  # of its path and words
    chain: tuple[int, ...]  # keys of the containers around it, the outermost first
    role: int  # by names: 0 apart, 1 none, 2 main, 3 article
    apart: tuple[int, bool]  # how many of chain are around or are the innermost element that is set apart, and whether that is one of them
    outside: tuple[int, bool]  # the same for page headers, which may also be an article's
    links: int  # characters in links


class Page(NamedTuple):
    tokens: list[int]  # keys of elements and texts, in order
    blocks: list[Block]
    many: set[int]  # of them containers with like siblings


class Element(NamedTuple):
    name: str
    role: int
    path: str
    chain: tuple[int, ...]
    apart: tuple[int, bool]
    outside: tuple[int, bool]
    children: Counter


NONE = (0, False)
TOP = Element("", 1, "", (), NONE, NONE, Counter())


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


@lru_cache(maxsize=1 << 16)
def _attributes(attrs: str) -> tuple[frozenset[str], bool, bool, bool]:
    """The words of class, id and role; whether they set the element apart, or tell a page's head; and whether it is hidden."""
    words, hidden, apart, outside, foreign = set(), False, False, False, False
    for name, value in NAMED.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            for token in value.split():
                own = {w.lower() for w in WORDS.findall(token)}
                words |= own
                telling = own & (APART_WORDS | OUTSIDE_WORDS)
                rest = {w for w in own - APART_WORDS - OUTSIDE_WORDS - NEUTRAL if not w.isdigit()}
                foreign |= bool(telling and rest)
                apart |= bool(own & APART_WORDS)
                outside |= bool(own & OUTSIDE_WORDS)
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        else:
            hidden |= name == "hidden" or value.lower() == "true"
    return frozenset(words), apart and not foreign, outside and not foreign, hidden


def parse(source: str) -> Page:
    """Tokens and text blocks of a page, in order."""
    tokens: list[int] = []
    blocks: list[Block] = []
    many: set[int] = set()
    stack: list[Element] = []
    text: list[str] = []
    linked = [0, 0]  # open links, characters of this block in links

    def close() -> None:
        joined = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if joined:
            e = stack[-1] if stack else TOP
            key = _hash(f"{e.path} {joined}")
            blocks.append(Block(joined, key, e.chain, e.role, e.apart, e.outside, min(linked[1], len(joined))))
            tokens.append(key)
        linked[1] = 0

    def pop(k: int) -> None:
        if any(e.name in BLOCKS for e in stack[k:]):
            close()
        linked[0] -= sum(e.name == "a" for e in stack[k:])
        del stack[k:]

    def last(names: tuple[str, ...] | set[str] | frozenset[str], until: tuple[str, ...] = ()) -> int:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].name in names:
                return k
            if stack[k].name in until:
                return -1
        return -1

    top = TOP._replace(children=Counter())
    at = 0
    for m in TOKEN.finditer(source):
        if m.start() > at:
            text.append(source[at : m.start()])
            if linked[0]:
                linked[1] += len(" ".join(text[-1].split()))
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            k = last((name,), () if name in BLOCKS else ("article", "section", "div", "td", "li"))
            if k >= 0:
                pop(k)
            elif name in ("p", "br"):
                text.append(" ")
            continue
        if name == "br" or name == "wbr":
            text.append(" " if name == "br" else "")
            continue
        if name in BLOCKS:
            close()
        if name in CLOSES_P and (k := last(("p",), ("article", "section", "div", "td", "th", "li", "table", "body", "nav", "aside", "form", "footer", "header", "main", "blockquote", "button"))) >= 0:
            pop(k)
        if name in SIBLINGS:
            ends, until = SIBLINGS[name]
            while (k := last(tuple(ends.split()), until)) >= 0:
                pop(k)
        words, apart, outside, hidden = _attributes(m["attrs"]) if m["attrs"] else (frozenset(), False, False, False)
        above = stack[-1] if stack else top
        path, chain, set_apart, head = above.path, above.chain, above.apart, above.outside
        named = name not in ("html", "body", "article", "main")
        apart = hidden or name in APART or (apart and named)
        outside = (name in OUTSIDE or (outside and named and name != "h1")) and above.role < 2
        if name in BLOCKS:
            step = f"{name}.{'.'.join(sorted(words))}" if words else name
            path = f"{path}/{step}"
            if name in CONTAINERS:
                above.children[step] += 1
                n, inside = above.children[step], f"{chain[-1] if chain else ''}/{step}"
                key = _hash(f"{inside}[{n}]")
                if n > 1:
                    many |= {key, _hash(f"{inside}[1]")}
                chain = (*chain, key)
                tokens.append(key)
            else:
                tokens.append(_hash(path))
        place = (len(chain), name in CONTAINERS)
        if apart or above.role == 0 or outside:
            role = 0
        elif name == "article" or above.role == 3:
            role = 3
        elif name == "main" or above.role == 2 or (words & MAIN_WORDS and name not in ("html", "body")):
            role = 2
        else:
            role = 1
        if name not in VOID and not m["attrs"].endswith("/"):
            stack.append(Element(name, role, path, chain, place if apart else set_apart, place if outside else head, Counter()))
            linked[0] += name == "a"
    text.append(source[at:])
    close()
    return Page(tokens, blocks, many)


def orders(page: Page, classes: dict[int, int]) -> dict[int, int]:
    """By class, what must be the same on all pages that have it: the order of its tokens and, if they repeat outside of one gap between the tokens that come once and have no like sibling, after which of these they come; 0 if they don't come in rounds."""
    held: dict[int, list[tuple[int, int]]] = defaultdict(list)
    times, gap = Counter(page.tokens), 0
    for k in page.tokens:
        if (c := classes.get(k)) is not None:
            gap = k if times[k] == 1 and k not in page.many else gap
            held[c].append((k, gap))
    out = {}
    for c, members in held.items():
        seen = [k for k, _ in members]
        first = list(dict.fromkeys(seen))
        rounds = len(seen) // len(first)
        gaps = [g for _, g in members] if rounds > 1 and len({g for _, g in members}) > 1 else []
        out[c] = _hash(repr((first, gaps))) >> 1 | 1 if first * rounds == seen else 0
    return out


class Slot(NamedTuple):
    """What a container that comes once holds on one page."""

    e: int
    c: int
    depth: int
    inner: int  # 0 for the page, its html and its body
    score: int
    chars: int
    links: int


def slots(p: Page, classes: dict[int, int], once: frozenset[int] | set[int]) -> tuple[list[tuple[int, ...]], list[Slot]]:
    """The slots around each block, and the page's slots. score counts all text inside, chars and links what is in no inner slot."""
    chains, found = [], {0: [0, 0, 0, 0, 0, 0]}
    for b in p.blocks:
        chain = tuple(e for e in b.chain if e in once)
        chains.append(chain)
        if b.key in classes:
            continue
        score = max(0, len(b.text) - 2 * b.links) * (1 if b.role == 0 else ABOUT)
        for depth, e in enumerate((0, *chain)):
            x = found.setdefault(e, [classes.get(e, 0), depth, int(depth > 0 and b.chain.index(e) > 1), 0, 0, 0])
            x[3] += score
        x[4] += len(b.text)
        x[5] += b.links
    return chains, [Slot(e, *x) for e, x in found.items()]


def place_of(p: tuple[int, bool], b: Block, chain: tuple[int, ...]) -> int:
    """Where in chain an element is: 2 * k for its k-th, an odd number for one between, 0 for none."""
    n, own = p
    if not n and not own:
        return 0
    inside = [e for e in b.chain[:n] if e in chain]
    return 2 * len(inside) + (not own or b.chain[n - 1] not in chain)


def article(p: Page, texts: set[int], chains: list[tuple[int, ...]], main: Slot | None, heavy: set[int], menus: set[int], valid: set[int]) -> str:
    """A page's text, plainly; extract() does the same with SQL functions."""
    best = max(1, max((b.role for b in p.blocks), default=1))
    there = main is not None and any(main.e in c for c in chains)
    out = []
    for b, chain in zip(p.blocks, chains, strict=True):
        own = [e for e in chain if e in valid]
        if b.key in texts:
            continue
        if there and main.e in chain:
            at = 2 * (chain.index(main.e) + 1)
            keep = place_of(b.apart, b, chain) <= at and (main.inner or place_of(b.outside, b, chain) <= at) and not (own[-1] in menus and own[-1] != main.e)
        else:
            keep = b.role == best and not (there and own and own[-1] not in heavy)
        if keep:
            out.append(b.text)
    return "\n".join(out)


def extract_group(sources: list[str]) -> list[str]:
    """The main texts of pages of one host: extract() in small, in plain loops."""
    parsed = {s: parse(s) for s in dict.fromkeys(sources)}
    pages = [p for p in parsed.values() if p.blocks]
    vectors: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, p in enumerate(pages):
        for k, n in Counter(p.tokens).items():
            vectors[k].append((i, n))
    often = {k: v for k, v in vectors.items() if len(pages) >= LEAST and len(v) >= max(LEAST, SHARE * len(pages))}
    classes = {k: hash(tuple(v)) for k, v in often.items()}
    once = {k for k, v in often.items() if all(n == 1 for _, n in v)}
    found: dict[int, set[int]] = defaultdict(set)
    sums: dict[int, Slot] = {}
    chains = {}
    for s, p in parsed.items():
        for c, o in orders(p, classes).items():
            found[c].add(o)
        chains[s], held = slots(p, classes, once)
        for x in held if p.blocks else ():
            y = sums.get(x.e, x._replace(score=0, chars=0, links=0))
            sums[x.e] = x._replace(depth=max(x.depth, y.depth), inner=max(x.inner, y.inner), score=x.score + y.score, chars=x.chars + y.chars, links=x.links + y.links)
    bad = {c for c, o in found.items() if len(o) > 1 or 0 in o}
    valid = {k for k, c in classes.items() if c not in bad}
    total = sums[0].score if 0 in sums else 0
    heavy = {e: x for e, x in sums.items() if e in valid and total > 0 and x.score >= MAIN * total}
    main = max(heavy.values(), key=lambda x: (x.depth, x.e), default=None)
    menus = {e for e, x in sums.items() if e in valid and x.chars and x.links >= LINKS * x.chars}
    return [article(parsed[s], valid, chains[s], main, set(heavy), menus, valid) for s in sources]


SLOT = pa.struct([("e", pa.int64()), ("c", pa.int64()), ("depth", pa.int32()), ("inner", pa.int32()), ("score", pa.int64()), ("chars", pa.int64()), ("links", pa.int64())])
BLOCK = pa.struct([("text", pa.string()), ("c", pa.int64()), ("chain", pa.list_(pa.int64())), ("classes", pa.list_(pa.int64())), ("role", pa.int32()), ("apart", pa.int32()), ("outside", pa.int32())])
ORDER = pa.struct([("c", pa.int64()), ("o", pa.int64())])
READ = "blocks array<struct<text:string,c:long,chain:array<long>,classes:array<long>,role:int,apart:int,outside:int>>, found array<struct<c:long,o:long>>, slots array<struct<e:long,c:long,depth:int,inner:int,score:long,chars:long,links:long>>"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every row. Pages are parsed for the counts and again for their slots; a task holds a batch and a host's classes."""
    kind = dict(pages.dtypes)[id_col]
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))

    def count(batch: pa.RecordBatch) -> dict:
        made = [Counter(p.tokens) if p.blocks else {} for p in (parse(x.as_py()) for x in batch.column(2))]
        return {"host": batch.column(0), "page": batch.column(1), "tokens": pa.array([[{"t": t, "n": n} for t, n in c.items()] for c in made], pa.list_(pa.struct([("t", pa.int64()), ("n", pa.int32())])))}

    counted = by_batch(rows.select("host", F.xxhash64("html").alias("page"), "html"), count, "host string, page long, tokens array<struct<t:long,n:int>>")
    different = stored(counted.groupBy("host", "page").agg(F.any_value("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies")), "different")
    hosts = stored(different.groupBy("host").agg(F.count_if(F.size("tokens") > 0).alias("pages"), F.sum("copies").alias("rows")), "hosts")
    parts = F.ceil(F.col("rows") / PART_ROWS).cast("int")
    large = F.broadcast(hosts.where(F.col("rows") > PART_ROWS).select("host", parts.alias("parts")))  # a host in PART_ROWS rows at most
    by_token = different.select("host", "page", F.inline("tokens")).groupBy("host", "t").agg(F.count(F.lit(1)).alias("support"), F.bit_xor(F.xxhash64("page", "n")).alias("c"), F.max("n").alias("most")).where(F.col("support") >= LEAST)
    often = by_token.join(hosts.where(F.col("pages") >= LEAST), "host").where(F.col("support") >= F.lit(SHARE) * F.col("pages"))
    every_part = F.explode(F.sequence(F.lit(0), parts - 1))
    classes = stored(often.groupBy("host", "rows").agg(F.collect_list(F.struct("t", "c", (F.col("most") == 1).alias("once"))).alias("classes")).select("host", "classes", every_part.alias("part")), "classes")
    dealt = rows.join(large, "host", "left").withColumn("part", F.pmod(F.xxhash64("html", "page_id"), F.coalesce("parts", F.lit(1))).cast("int"))
    met = dealt.join(classes, ["host", "part"], "left").select("page_id", "url", "host", "part", F.xxhash64("html").alias("page"), "html", "classes")

    def read(batch: pa.RecordBatch) -> dict:
        blocks, found, held, last, classes, once = [], [], [], None, {}, set()
        for h, source, made in zip(batch.column(2).to_pylist(), batch.column(5), batch.column(6), strict=True):
            if h != last:
                own = made.as_py() or []
                last, classes, once = h, {x["t"]: x["c"] for x in own}, {x["t"] for x in own if x["once"]}
            p = parse(source.as_py())
            chains, sums = slots(p, classes, once) if classes else ([()] * len(p.blocks), [])
            blocks.append([{"text": b.text, "c": classes.get(b.key), "chain": chain, "classes": [classes[e] for e in chain], "role": b.role, "apart": place_of(b.apart, b, chain), "outside": place_of(b.outside, b, chain)} for b, chain in zip(p.blocks, chains, strict=True)])
            found.append([{"c": c, "o": o} for c, o in orders(p, classes).items()] if classes else [])
            held.append([x._asdict() for x in sums])
        return dict(zip(("page_id", "url", "host", "part", "page"), batch.columns[:5], strict=True)) | {"blocks": pa.array(blocks, pa.list_(BLOCK)), "found": pa.array(found, pa.list_(ORDER)), "slots": pa.array(held, pa.list_(SLOT))}

    parsed = stored(by_batch(met, read, f"page_id {kind}, url string, host string, part int, page long, {READ}"), "parsed")
    invalid = stored(parsed.select("host", F.inline("found")).groupBy("host", "c").agg(F.min("o").alias("o1"), F.max("o").alias("o2")).where("o1 = 0 or o1 <> o2").select("host", "c"), "invalid")
    # Copies of a page count as one in the classes, and so they do here.
    first = parsed.select("host", "page", "slots").where(F.size("slots") > 0).groupBy("host", "page").agg(F.any_value("slots").alias("slots"))
    sums = first.select("host", F.inline("slots")).groupBy("host", "e").agg(F.max("c").alias("c"), F.max("depth").alias("depth"), F.max("inner").alias("inner"), F.sum("score").alias("score"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    sums = sums.join(invalid, ["host", "c"], "left_anti")
    held = sums.groupBy("host").agg(F.max(F.when(F.col("e") == 0, F.col("score"))).alias("total"), F.collect_list(F.when(F.col("e") != 0, F.struct("depth", "e", "inner", "score", "chars", "links"))).alias("slots"))
    heavy = F.filter("slots", lambda x: (F.col("total") > 0) & (x["score"] >= MAIN * F.col("total")))
    menus = F.transform(F.filter("slots", lambda x: (x["chars"] > 0) & (x["links"] >= LINKS * x["chars"])), lambda x: x["e"])
    held = held.select("host", F.array_max(F.transform(heavy, lambda x: F.struct(x["depth"].alias("depth"), x["e"].alias("e"), x["inner"].alias("inner")))).alias("main"), F.transform(heavy, lambda x: x["e"]).alias("heavy"), menus.alias("menus"))
    bad = invalid.groupBy("host").agg(F.collect_list("c").alias("bad"))
    known = stored(hosts.where(F.col("pages") >= LEAST).join(held, "host", "left").join(bad, "host", "left").select("host", "main", "heavy", "menus", F.coalesce("bad", F.array().cast("array<long>")).alias("bad"), every_part.alias("part")), "known")
    there = F.coalesce(F.exists("blocks", lambda b: F.array_contains(b["chain"], F.col("main.e"))), F.lit(False))
    best = F.greatest(F.lit(1), F.array_max(F.transform("blocks", lambda b: b["role"])))
    judged = parsed.join(known, ["host", "part"], "left").select("page_id", "url", "blocks", "main", "heavy", "menus", "bad", there.alias("there"), best.alias("best"))

    def keep(b: Column) -> Column:
        at = F.array_position(b["chain"], F.col("main.e")).cast("int")
        valid = F.filter(F.arrays_zip(b["chain"].alias("e"), b["classes"].alias("c")), lambda x: ~F.array_contains("bad", x["c"]))
        innermost = F.try_element_at(valid, F.lit(-1))["e"]
        inside = (b["apart"] <= 2 * at) & ((F.col("main.inner") > 0) | (b["outside"] <= 2 * at)) & ~F.coalesce(F.array_contains("menus", innermost) & (innermost != F.col("main.e")), F.lit(False))
        beside = F.col("there") & F.coalesce(~F.array_contains("heavy", innermost), F.lit(False))
        fills = b["c"].isNull() | F.array_contains("bad", b["c"])
        return fills & F.when(F.col("there") & (at > 0), inside).otherwise((b["role"] == F.col("best")) & ~beside)

    return judged.select("page_id", "url", F.array_join(F.transform(F.filter("blocks", keep), lambda b: b["text"]), "\n").alias("text"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op8_html": op8_html}
ORACLE: dict[str, str] = {}
