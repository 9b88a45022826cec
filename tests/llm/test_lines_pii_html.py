from __future__ import annotations

import hashlib
import html
import random
import re
import time
from collections import defaultdict

import duckdb
import pyarrow as pa
import regex

from treeq.llm import html as extraction
from treeq.llm import lines, pii

# lines

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def dedup_by_hand(rows: list[tuple], least_chars: int, least_docs: int) -> list[tuple]:
    key = lambda x: x.strip(WHITE).translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least_chars:
                holders[key(x)].add(i)
    common = {k: max((i for i in h if i is not None), default=None) for k, h in holders.items() if len(h) >= least_docs}
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if key(x) not in common or common[key(x)] == i]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows() -> list[tuple]:
    rng = random.Random(4)
    pool = ["Shared LINE number %d with ümlaut" % i for i in range(6)] + ["shared line number 1 WITH ümlaut\t", "  Plain shared ascii line 7 here", "PLAIN SHARED ascii line 7 here\r", "short", "", "\x0bPlain shared ascii line 7 here", "Kelvin K sign line that is long", "kelvin K sign line that is long"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    return [*rows, (None, pool[0] + "\n" + pool[7]), (70, None), (71, ""), (72, "\n\n"), (73, pool[1]), (73, pool[1] + "\nother text here"), (74, "\n".join(pool[:3] * 2000)), rows[3]]


def test_line_dedup(spark) -> None:  # noqa: ANN001
    rows = line_rows()
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, kept string, h int")
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in lines.dedup_lines(df, least_chars=20, least_docs=4, batches=5).collect()]
    assert sorted(got, key=str) == dedup_by_hand(rows, 20, 4)
    assert lines.dedup_lines(df.where("false")).count() == 0
    with_rest = lines.dedup_lines(df, with_rest=True)
    assert with_rest.columns == ["doc_id", "text", "rest", "n_lines", "n_dropped", "kept"] and with_rest.first().rest.asDict() == {"kept": "x", "h": 5}


def test_many_dropped_lines(spark) -> None:  # noqa: ANN001
    """A text of 100,000 lines of which every second goes: linear in the lines."""
    line = lambda k: f"a line that five documents share, number {k}"
    long = "\n".join(line(k % 1000) if k % 2 else str(k) for k in range(100_000))
    rows = [(0, long), *((i, "\n".join(map(line, range(1000)))) for i in range(1, 6))]
    began = time.perf_counter()
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.perf_counter() - began < 60
    assert got[0].n_dropped == 50_000 and got[0].kept == "\n".join(str(k) for k in range(0, 100_000, 2)) and got[5].n_dropped == 0


def test_line_sql() -> None:
    rows = [(i, t) for i, t in line_rows() if i is not None and i < 73]
    rows = list({i: (i, t) for i, t in rows}.values())
    wide = [(i, t and t.replace("line", "line that is made long enough for the rule")) for i, t in rows]
    documents = pa.table({"doc_id": [i for i, _ in wide], "text": pa.array([t for _, t in wide], pa.string())})  # noqa: F841  by name in SQL
    got = duckdb.execute(lines.SQL).fetchall()
    want = [(i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in dedup_by_hand(wide, 40, 5)]
    assert sorted(got) == sorted(want)


def test_runs_are_levelled(spark) -> None:  # noqa: ANN001
    store = lines.LineStore(spark, fanout=2)
    batch = lambda *keys: spark.createDataFrame([(bytes([k]), 1, k) for k in keys], "h binary, n_docs long, last_id long")
    for keys in ((1, 2), (2, 3), (3, 4), (9,), (1, 9)):
        assert sorted(r.h[0] for r in store.unseen(batch(*keys)).collect()) == sorted(set(keys) - {r.h[0] for r in store.merged().collect()})
        store.add(batch(*keys))
    assert [len(x) for x in store.levels] == [1, 0, 1]
    assert sorted((r.h[0], r.n_docs) for r in store.merged().collect()) == [(1, 2), (2, 2), (3, 2), (4, 1), (9, 2)]
    assert store.keys().where("fresh").count() == 5


# personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def pii_by_hand(text: str) -> list[tuple[int, int, int]]:
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15)[kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_pii(spark) -> None:  # noqa: ANN001
    rng = random.Random(6)
    parts = ["a@b.c", "x.y@d-e.com", "@", ".", "..", "1.2.3.4", "256.1.1.1", "01.002.0003.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+", "12", " ", "-", "é😀", "\n", "_", "%", "4111111111111111", "+49 30 123456", "b.c@d.e_f@g.h"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    hard = lambda n: ["a." * n + "@" + "b." * n + "c", "1" * 2 * n, "1." * n, "+1" * (n // 2) + "(" * (n // 2), "mail a@b.c " * (n // 10), "x" * 2 * n]
    texts += [None, "", *hard(4000)]  # by hand the time grows with the square of the length
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    for r in pii.find(df).collect():
        assert [tuple(s) for s in r.base] == pii_by_hand(texts[r.doc_id] or ""), texts[r.doc_id][:200]
    assert pii.find(df.where("false")).count() == 0
    long = spark.createDataFrame(list(enumerate(hard(100_000))), "doc_id long, text string")
    assert {r.doc_id: len(r.base) for r in pii.find(long).collect()} == {0: 1, 1: 0, 2: 25_000, 3: 0, 4: 10_000, 5: 0}


def test_contexts_discover(spark) -> None:  # noqa: ANN001
    rows = [(i, f"word{i % 7} mail me{i}@x{i}.org and call {i % 3} then ring +1 (212) 555-01{i:02d} ok") for i in range(30)]
    rows += [(100, "mail me-without-at77 now"), (None, "mail other88 now"), (100, "mail third99 now"), (100, "mail third99 now"), (101, "see page 12345 now")]
    found = [(r.doc_id, [tuple(s) for s in r.spans if s.kind == 4]) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted((x for x in found if x[1]), key=str) == sorted([(100, [(5, 4, 20)]), (None, [(5, 4, 12)]), (100, [(5, 4, 12)]), (100, [(5, 4, 12)])], key=str)


def contexts_by_hand(texts: list[str]) -> list[set[tuple[int, int]]]:
    """Patterns and instances in plain loops: the spans that are discovered in each text."""
    run = r"[A-Za-z0-9._%+@/-]"
    candidate = regex.compile(rf"(?<!\p{{L}})((?:\p{{L}}++[:#]?+[ \t]++)?)(\p{{L}}++[:#]?+)[ \t]++(?={run}*[0-9])({run}{{5,}}+)")
    seen = []
    for k, t in enumerate(texts):
        spans = pii_by_hand(t)
        for m in candidate.finditer(t):
            word, before = m[2].lower(), " ".join(f"{m[1]}{m[2]}".lower().split())
            shape = re.sub("[0-9]+", "9", re.sub("[A-Za-z]+", "a", m[3]))
            patterns = {f"1 {word}", f"3 {word} {shape}"} | ({f"2 {before}"} if m[1] else set())
            seen.append((k, m.span(3), m[3], patterns, any(a < m.end(3) and m.start(3) < b for a, _, b in spans)))
    edges: dict[tuple[str, str], bool] = {}
    for _, _, x, patterns, seed in seen:
        for p in patterns:
            edges[p, x] = edges.get((p, x), False) or seed
    belief = {e: float(seed) for e, seed in edges.items()}
    for _ in range(2):
        scores = {p: sum(b for e, b in belief.items() if e[0] == p) / (sum(e[0] == p for e in edges) + 1) for p, _ in edges}
        told: dict[str, float] = {}
        for (p, x), seed in edges.items():
            told[x] = told.get(x, 1.0) * (1 if seed else 1 - scores[p])
        belief = {(p, x): 1.0 if seed else 1 - told[x] for (p, x), seed in edges.items()}
    good = {p for p in scores if scores[p] >= 0.8 and sum(seed for e, seed in edges.items() if e[0] == p) >= 5}
    out: list[set[tuple[int, int]]] = [set() for _ in texts]
    for k, span, _, patterns, seed in seen:
        if not seed and patterns & good:
            out[k].add(span)
    return out


def test_contexts_by_hand(spark) -> None:  # noqa: ANN001
    rng = random.Random(9)
    made = [lambda k: f"mail me{k}@x.org", lambda k: f"Mail: me{k}@x.org", lambda k: f"please ring +1 212 555 {k:04d}", lambda k: f"host 10.0.{k % 200}.{k % 7}", lambda k: f"page {k:05d}", lambda k: f"write to u{k}@y.net", lambda k: f"sent to box-{k:04d}", lambda k: f"host box{k:04d}", lambda k: "and so on"]
    texts = [" ".join(rng.choice(made)(rng.randint(0, 400)) + rng.choice([" ok", ",", " "]) for _ in range(rng.randint(0, 6))) for _ in range(400)]
    texts += ["mail me-without-at77 now", "write to other88 now", "host 10.0.0.x5 up", "please ring 212-555-9999"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: {(s.start, s.end) for s in r.spans if s.kind == 4} for r in pii.find(df).collect()}
    want = contexts_by_hand(texts)
    assert [got[i] for i in range(len(texts))] == want and sum(map(len, want)) > 10


# pages

MALFORMED = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="home">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></ul></nav><div class="cookie-notice">Cookies!</div><!-- <p>no</p> -->
<main><article><h1>Title &amp; more</h1><p><b>One&nbsp;two.<br>  three<p>Four &lt;five&gt; &copy; &unknown; &#233;<div class="ad">Buy</div><ul><li>x<li>y</ul><form><input value=">"><p>Mail</form>
<table><tr><td>1<td>2</table><aside>Side</aside><p hidden>gone</p><p style="display: none">gone</p></article>
<section id="comments"><article class="comment"><p>First!</p></article></section></main><div class="sidebar">More</div><footer>&copy; F</footer>"""


def test_article_by_roles() -> None:
    assert extraction.extract_group([MALFORMED])[0].split("\n") == ["Title & more", "One two. three", "Four <five> © &unknown; é", "x", "y", "1", "2"]
    assert extraction.extract_group([""]) == [""] and extraction.extract_group(["<p>only text"]) == ["only text"]
    assert extraction.extract_group(["<div class='post-content'><p>body</p></div><div class='tags'>t</div>"]) == ["body"]
    assert extraction.extract_group(["<p>" * 3000 + "deep"]) == ["deep"]


def test_template_of_a_host(spark) -> None:  # noqa: ANN001
    rng = random.Random(2)
    body = lambda i: "".join(f"<p>{html.escape(' '.join(rng.choice(['alpha', 'beta', '&', 'gamma']) for _ in range(8)))} {i}.{k}</p>" for k in range(3))
    bodies = [body(i) for i in range(20)]
    rows = [(i, f"https://Site.example/{i}", f"<body><div><p>Always the same words</p></div><div>{b}</div><div><p>End of page</p></div></body>") for i, b in enumerate(bodies)]
    rows += [(30, "https://other.example/1", "<p>Always the same words</p>"), (None, None, None), (31, "", ""), (30, "https://other.example/1", "<p>Always the same words</p>")]
    got = [tuple(r) for r in extraction.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()]
    plain = lambda b: "\n".join(html.unescape(x) for x in re.findall(r"<p>(.*?)</p>", b))
    want = [(i, u, plain(bodies[i]) if i is not None and i < 20 else "Always the same words" if i == 30 else "") for i, u, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_are_no_template() -> None:
    page = "<article><p>One text</p><p>Two</p></article>"
    assert extraction.extract_group([page] * 30) == ["One text\nTwo"] * 30


def test_template_is_the_host_s(spark, monkeypatch) -> None:  # noqa: ANN001
    """Beside empty pages and another layout, on any page of a large host, and not what a few near copies share."""
    monkeypatch.setattr(extraction, "PART_ROWS", 30)
    page = lambda i: f"<div><p>Own {i}</p></div>" + ("<div><p>On half of the pages</p></div>" if i % 2 else "") + f"<section><p>{'Same end' if i % 3 else 'Other end'}</p></section>"
    rows = [(i, "http://a.example/", page(i)) for i in range(71)] + [(100 + i, "http://a.example/", "" if i % 2 else None) for i in range(6)]
    rows += [(200 + i, "http://a.example/", f"<div><p>Copied article</p></div><p>{i}</p>") for i in range(9)]
    got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: f"Own {i}" for i in range(71)} | {100 + i: "" for i in range(6)} | {200 + i: f"Copied article\n{i}" for i in range(9)}
    assert got == want


def site(rng: random.Random, host: str, n: int) -> list[tuple]:
    """Pages of a host, of random layout: named or not, with menus, repeated notes, stray elements, empty pages and copies."""
    named, tables = rng.random() < 0.5, rng.random() < 0.3
    words = lambda k: " ".join(rng.choice(["sun", "moon", "star", "sky", "tree"]) + str(rng.randint(0, 99)) for _ in range(k))
    box = lambda inner, name: f"<table><tr><td>{inner}</td></tr></table>" if tables else f"<div class='{name}'>{inner}</div>" if named else f"<div>{inner}</div>"
    out = []
    for i in range(n):
        links = "".join(f"<li><a href='/{k}'>{words(1)}</a>" for k in range(6))
        note = "".join("<div><p>Read on</p><p>Tagged note</p></div>" for _ in range(i % 4))
        odd = rng.choice(["", "", "<div class='notice-of-theorem search'><p>Theorem</p></div>", "<div class='ad banner'>Buy</div>", "<form><p>Mail</p></form>", "<header><h2>Head of it</h2></header>"])
        body = f"<h1>{words(4)}</h1>" + "".join(f"<p>{words(rng.randint(3, 30))}" for _ in range(rng.randint(1, 5))) + note + odd
        page = f"<html><body>{box(f'<ul>{links}</ul>', 'menu')}{box('<p>Always the same</p>', 'top')}{box(body, 'social-history')}{box(f'<p>{words(3)}', 'end') if i % 3 else ''}<footer>{words(2)}</footer></body></html>"
        out.append((None if rng.random() < 0.02 else len(out), f"http://{host}/{i}", rng.choices([page, "", None, "<p>maintenance</p>", out[-1][2] if out else page], [20, 1, 1, 1, 1])[0]))
    return out


def test_slots_against_plain_loops(spark, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(extraction, "PART_ROWS", 25)
    rng = random.Random(11)
    sites = [site(rng, f"h{k}.example", rng.choice([3, 9, 30, 60])) for k in range(10)]
    want = sorted(((i, u, t) for rows in sites for (i, u, _), t in zip(rows, extraction.extract_group([x or "" for _, _, x in rows]), strict=True)), key=str)
    assert len({t for _, _, t in want}) > 100
    pages = [r for rows in sites for r in rows]
    rng.shuffle(pages)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for parts in (1, 7, 61):
        assert sorted((tuple(r) for r in extraction.extract(df.repartition(parts)).collect()), key=str) == want


def test_names_are_not_needed() -> None:
    """Sites without telling names, with names that mislead, with notes that repeat, and with an odd page."""
    page = lambda i, tag, name: f"<body><div><ul><li><a href='/'>Home {i}</a></ul></div><{tag} class='{name}'><h1>Essay {i}</h1><p>Words of the essay number {i} that go on and on{' and on' * 9}.</p>{'<div><p>Read on</p><p>Tagged note</p></div>' * (i % 5 + 1)}</{tag}><div><p>Foot {i}</p></div></body>"
    for tag, name in (("div", ""), ("article", ""), ("div", "social-history"), ("div", "sidebar")):
        got = extraction.extract_group([*(page(i, tag, name) for i in range(20)), "<body><h1>maintenance</h1></body>"])
        assert got == [*(f"Essay {i}\nWords of the essay number {i} that go on and on{' and on' * 9}." for i in range(20)), "maintenance"]
    theorem = lambda i: f"<article><h1>T{i}</h1><p>Own words {i}.</p><div class='notice-of-theorem search'><p>Theorem {i}</p></div></article>"
    assert extraction.extract_group([theorem(i) for i in range(20)])[3] == "T3\nOwn words 3.\nTheorem 3" == extraction.extract_group([theorem(3)])[0]
