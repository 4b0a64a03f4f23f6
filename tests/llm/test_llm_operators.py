import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from floodgrid.llm import importance, linededup, media, neardup, packing, pii, repetition, spm, text, tokencount, wrapper

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


# packing


def test_pack_places_every_id_once(docs, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = packing.pack(docs, P.path("word_bpe_49k.json"), size=256, keep_ids=True, most_open=8).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    for doc, t in corpus:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(pieces[doc], key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == ids
        assert all(r["doc_tokens"] == len(ids) and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in own)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 256 or at & (at - 1) == 0


def test_pack_edges(odd, none):
    path = P.path("word_bpe_49k.json")
    assert packing.pack(none, path).count() == 0
    got = packing.pack(odd, path).collect()
    ends = Counter(r["doc_id"] for r in got if r["start"] + r["length"] == r["doc_tokens"])
    assert ends == {None: 2, 3: 2, 4: 1, 5: 1} and {r["doc_tokens"] for r in got if r["doc_id"] in (4, 5)} == {1}
    with pytest.raises(ValueError):
        packing.pack(odd, path, size=100)


def test_ids_of_every_character_and_script():
    """Each code point up to U+024F in, before and after a word and alone, then random strings of all scripts."""
    encoder, rng = packing.WordEncoder(P.path("word_bpe_49k.json")), random.Random(6)
    texts = [t for i in range(0x250) for c in [chr(i)] for t in (c, f"ab{c}cd", f"{c}word", f"Word{c}", f"a {c} 1{c}2", c * 3)]
    blocks = [(0x20, 0x7F), (0xA0, 0x250), (0x180, 0x250), (0x250, 0x600), (0x600, 0x1200), (0x1E00, 0x2100), (0x2C60, 0x2C80), (0x3040, 0x3100), (0x4E00, 0x5000), (0xFB00, 0xFE00), (0x1D400, 0x1D500), (0x1F300, 0x1F600)]
    for _ in range(6000):
        some = rng.sample(blocks, rng.randint(1, 2))
        texts.append("".join(chr(rng.randrange(*rng.choice(some))) if rng.random() < 0.8 else rng.choice(" \n\t'.A") for _ in range(rng.randint(1, 30))))
    got = encoder.encode(texts)
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, ascii(t)


def test_sum_of_squares_picks_the_least_sum():
    rng = random.Random(1)
    state = packing.SumOfSquares(50, most=10_000)
    for i in range(300):
        n = rng.randint(1, 49)
        before = state.levels.copy()
        choices = {}
        for h in range(0, 51 - n):
            if h == 0 or before[h]:
                after = before.copy()
                after[h] -= h > 0
                after[h + n] += h + n < 50
                choices[h] = int((after[1:50] ** 2).sum())
        state.put((i, 0, b""), n)
        assert int((state.levels[1:50] ** 2).sum()) == min(choices.values())
    total = sum(f * len(w) for f, w in state.at.items())
    done = state.drain(1)
    assert all(sum(n for _, n in w) == 50 for w in done) and state.open <= 1
    assert sum(n for w in done for _, n in w) + sum(n for ws in state.at.values() for w in ws for _, n in w) == total


# html


def pages_of(n):
    rng = random.Random(2)
    out = []
    for i in range(n):
        body = "".join(f"<p>{' '.join(str(rng.random()) for _ in range(5))}" for _ in range(3))
        out.append((i, f"http://h{i % 2}.example/{i}", f"<html><head><title>x</title></head><body><nav><a>menu</a></nav><div class=content><p>Welcome to our site</p>{body}</div><footer>f</footer>"))
    return out


def test_wrapper_drops_constant_blocks(spark):
    pages = spark.createDataFrame(pages_of(24), "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrapper.extract(pages).collect()}
    assert len(got) == 24 and not any("Welcome" in t or "menu" in t or t.endswith("f") for t in got.values())
    alone = {r["page_id"]: r["text"] for r in wrapper.extract(pages.limit(3)).collect()}
    assert all(t.startswith("Welcome to our site 0.") for t in alone.values())


def test_wrapper_keeps_copies_and_handles_odd_pages(spark):
    rows = [(i, "http://one.example/x", "<article><p>same &amp; text<br>line</article>") for i in range(9)]
    rows += [(10, None, "<p>a<b>b</b>c"), (11, "http://e", None), (12, "nonsense", ""), (13, "http://t", "<article><h1>cut &amp;&am</h1><script>x<p>"), (14, "http://d", "<div>" * 3000 + "deep")]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[0] == "same & text line" and got[10] == "abc" and got[11] == got[12] == "" and got[13] == "cut &&am" and got[14] == "deep"
    assert wrapper.extract(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0


def test_wrapper_quotes_in_tags_swallow_no_text():
    pages = {
        "<p title=Bob's>First words here.</p><p>It's second.</p>": "First words here. It's second.",
        '<p class="x"">One.</p><p id="y">Two "q".</p>': 'One. Two "q".',
        "<p a='1'b'>It's one</p><p ='c>It's two</p>": "It's one It's two",
        "<p title='a > b'>In</p><p a= >out</p>": "In out",
        '<p class="x>One</p><p>Two</p>': "One Two",
        "<p class = 'ad'>no</p><p title=it's class=ad>no</p><p class=x'>yes</p>": "yes",
    }
    assert {p: wrapper.main_text(p) for p in pages} == pages
    rng = random.Random(4)
    for _ in range(300):
        tags = ["".join(rng.choice(["a", " ", "b=c", "d='e'", 'f="g"', "h=i'j", 'k=l"', '"', "'"]) for _ in range(rng.randint(0, 5))) for _ in range(6)]
        page = "".join(f"<p {t} >it's{i}\"</p>" for i, t in enumerate(tags))
        assert wrapper.main_text(page) == " ".join(f"it's{i}\"" for i in range(6)), page


def test_wrapper_names_drop_no_article():
    pages = {
        '<div class="layout no-sidebar"><article><p>one</p></article></div>': "one",
        '<div class="page has-sidebar content"><p>one</p></div>': "one",
        '<div id="sidebar"><div class="menu"><main>one</main></div><p>two</p></div>': "one",
        "<body><form action=x.aspx><nav>menu</nav><div><p>one</p><p>two</p><input><button>go</button></div></form></body>": "one two",
        "<body><form action=x.aspx><article>one</article></form></body>": "one",
        "<header class=top><main>one</main></header>": "one",
        "<article><h1>t</h1>" + "".join(f"<section class={c}>{c}.</section>" for c in ("legal", "social", "search", "side")) + "</article>": "t legal. social. search. side.",
        "<article>one<div class='box ad'>no</div><div id=comments><article>no</article></div><form><p>no</p></form></article><p>more than the form</p>": "one",
        "<p>one, the longer text</p><div class='sidebar content'>no</div><div class=Footer>no</div><div role=navigation>no</div><form>mail <input></form>": "one, the longer text",
    }
    assert {p: wrapper.main_text(p) for p in pages} == pages


def test_wrapper_sees_layouts_notices_and_copies(spark):
    rng = random.Random(8)

    def own(k=3):
        return "".join(f"<p>{' '.join(str(rng.random()) for _ in range(6))}</p>" for _ in range(k))

    rows = []

    def add(host, pages):
        rows.extend((f"{host}{i}", f"http://{host}.example/{i}", p) for i, p in enumerate(pages))

    # a notice on 70 % of the pages; pages without any text
    add("notice", [f"<div>{'<p>We moved</p>' if i % 10 < 7 else ''}{own()}</div>" for i in range(40)] + ["<nav>x</nav>"] * 30)
    # two layouts, of 60 and 40 %
    add("layouts", [f"<div><p>Layout one</p>{own()}</div>" if i % 5 < 3 else f"<section><h2>Layout two</h2><div>{own()}</div></section>" for i in range(40)])
    # near copies of one article beside others, in the same structure and in one of their own
    article = [f"Part {k} {' '.join(str(rng.random()) for _ in range(6))}" for k in range(5)]
    copies = ["".join(f"<p>{t if k != i % 5 else 'changed ' + str(i)}</p>" for k, t in enumerate(article)) for i in range(30)]
    add("copies", [f"<div><p>Hello</p>{c}</div>" for c in copies] + [f"<div><p>Hello</p>{own(5)}</div>" for _ in range(20)])
    add("apart", [f"<section><p>Hello</p>{c}</section>" for c in copies] + [f"<div><p>Hello</p>{own(5)}</div>" for _ in range(40)])
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id string, url string, html string").repartition(4)).collect()}
    assert len(got) == len(rows) and not any(re.search("We moved|Layout|Hello", t) for k, t in got.items() if not k.startswith("apart"))
    for host in ("copies", "apart"):
        for i in range(30):
            assert all(t in got[f"{host}{i}"] for k, t in enumerate(article) if k != i % 5), (host, i)
    whole = {k: wrapper.main_text(p) for k, _, p in rows}
    assert all(t == re.sub("We moved |Layout (one|two) |Hello ", "", whole[k]) for k, t in got.items() if not k.startswith("apart"))


def brute_extract(rows, share=0.5, least=5):
    """The rule of ``extract`` in plain Python: (page_id, url, html) to text by page_id."""
    shaped = {}
    for _, url, page in rows:
        host = re.match(r"https?://([^/?#]*)", url or "")
        if host and page:
            structure, sizes = wrapper.placed(wrapper.blocks(wrapper.parse(page)))
            if sizes:
                shaped.setdefault(host[1], {})[frozenset(sizes)] = (structure, sizes)
    templates = {}
    for host, pages in shaped.items():
        if len(pages) < least:
            continue
        held = Counter(k for keys in pages for k in keys)
        weights, votes = defaultdict(float), defaultdict(float)
        for keys, (structure, sizes) in pages.items():
            told = [held[k] for k in keys for _ in range(sizes[k]) if not 1 < held[k] >= wrapper.NEARLY_ALL * len(pages)]
            w = 1 / np.percentile(told, 50) if told else 1.0
            for by in (None, structure):
                weights[by] += w
                for k in keys:
                    votes[by, k] += w if held[k] > 1 else 0
        templates[host] = frozenset(k for (by, k), v in votes.items() if round(v, 6) >= max(least, share * round(weights[by], 6)) and round(weights[by], 6) >= least)
    host = lambda url: (re.match(r"https?://([^/?#]*)", url or "") or [None, None])[1]
    return {i: wrapper.main_text(p or "", templates.get(host(u), frozenset())) for i, u, p in rows}


def test_wrapper_matches_brute_force(spark):
    rng = random.Random(21)
    word = lambda: str(rng.randrange(10**6))
    rows = []
    for h in range(6):
        notices = [f"notice {h} {k}" for k in range(4)]
        shared = [" ".join(word() for _ in range(8)) for _ in range(6)]
        for i in range(rng.randint(3, 40)):
            parts = [f"<p>{n}</p>" for n in notices if rng.random() < 0.6]
            parts += [f"<div><p>{rng.choice(shared) if rng.random() < 0.3 else ' '.join(word() for _ in range(6))}</p></div>" for _ in range(rng.randint(0, 4))]
            parts += [f"<section><h2>{notices[0]}</h2></section>"] * (rng.random() < 0.3)
            rows.append((len(rows), f"http://h{h}.example/{i}", f"<body>{''.join(parts)}</body>"))
    rows += [(len(rows) + k, *rows[k][1:]) for k in range(0, 60, 7)] + [(900, None, rows[0][2]), (901, "http://h0.example/x", None), (902, "http://h0.example/y", "")]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(4)).collect()}
    assert got == brute_extract(rows)
    plain = {i: wrapper.main_text(p or "") for i, _, p in rows}
    assert sum(got[i] != plain[i] for i in got) > len(rows) / 2  # the induced template decides on most pages


def test_wrapper_template_is_of_a_node(spark):
    """The text of a template node stays where it stands at another node."""
    pages = [(i, f"http://n.example/{i}", f"<div><p>Latest</p></div><article><h1>{i} title</h1><p>{'Latest' if i == 3 else f'text {i}'}</p></article><p>Latest</p>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    assert got == {i: f"{i} title " + ("Latest" if i == 3 else f"text {i}") for i in range(12)}


def test_wrapper_loses_no_text_and_no_story():
    story = "<p>" + "the story goes on and on " * 8 + "</p>"
    said = ("the story goes on and on " * 8).strip()
    pages = {
        "<p>a<!-->b</p><p>c</p>": "ab c",
        "<p>a<!--->b</p><p>c</p>": "ab c",
        "<p>a<!-- x --!>b</p><p>c</p>": "ab c",
        "<p>a<!-- x -- > y -->b</p>": "ab",
        "<p>a<!-- x": "a",
        "<p>one</p><svg/><p>two</p>": "one two",
        "<p>one</p><math /><p>two</p>": "one two",
        "<p>one</p><svg><path d='M0'/></svg><p>two</p>": "one two",
        f"<article>{story}</article><div id=comments><article>c1</article><article>c2</article></div>": said,
        f"<div>{story}</div><div class=comment-list><article>c1</article></div>": said,
        f"<div class=comments>{story}</div>": said,
        f"<article>{story}<div class=share>a</div><div class=newsletter-box>b</div><ul class=related-posts><li>c</ul><div class=notice>d</div></article>": said,
        f"<article>{story}<div id=disqus_thread>a</div><div class=ad-unit>b</div><div class=advertisement-block>c</div></article>": said,
        f"<div>{story}</div><div class=cookie-bar>a</div><div class=site-nav-wrap>b</div>": said,
        f"<div class=post-header-wrap>{story}</div><div class=sidebar-content>{story}</div>": f"{said} {said}",
    }
    assert {p: wrapper.main_text(p) for p in pages} == pages


def test_wrapper_keeps_what_the_contract_keeps():
    pages = {
        "<div id=content><p>the long story</p><p>goes on</p></div><article>teaser</article>": "the long story goes on teaser",
        "<article>" + "".join(f"<p class={c}>{c}</p>" for c in ("related-work", "search-algorithms", "legal", "notice")) + "</article>": "related-work search-algorithms legal notice",
        "<p>one<div class=userComments>no</div><ul id=commentlist><li>no</ul><div class='comments-section'>no</div><p class=commentary>two": "one two",
        "<p hidden>no<p>one<div aria-hidden=true>no</div><div style='DISPLAY : none'>no</div>": "one",
        '<a href="x>one</a> two': "one two",
        "<article>one<div id=comments><article>no</article></div></article>": "one",
    }
    assert {p: wrapper.main_text(p) for p in pages} == pages


def test_wrapper_takes_linear_time():
    hostile = ['<a "', "<b></x>", "<p><ul><b><div></div>", "<a b='x' c='>' ", "<div>", "<!-- ", '<a b="', "<form>t", "<li><p>", "<script>", "&"]
    begun = time.process_time()
    for piece in hostile:
        wrapper.main_text(piece * 50_000)
    wrapper.main_text("<b>" * 50_000 + "</x>" * 50_000)
    assert time.process_time() - begun < 60


def test_wrapper_edges(spark):
    rows = [(1, "http://e.example/a", "<p>x", "t", 1, 2), (1, "http://e.example/a", "<p>x", "t", 1, 2), (None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, template string, host int, `a.b` int")
    out = wrapper.extract(pages)
    assert out.columns == ["page_id", "url", "template", "host", "a.b", "text"]
    assert sorted((r["page_id"] or 0, r["template"], r["host"], r["a.b"], r["text"]) for r in out.collect()) == [(0, None, None, None, ""), (1, "t", 1, 2, "x"), (1, "t", 1, 2, "x")]


def test_simple_tree_matching_is_largest():
    def tree(spec):
        root = wrapper.Shape("r")
        number = iter(range(1, 100))
        root.index = 0

        def add(node, children):
            for tag, below in children:
                c = wrapper.Shape(tag)
                c.index = next(number)
                node.children.append(c)
                add(c, below)

        add(root, spec)
        return root

    a = tree([("a", []), ("b", [("c", []), ("d", [])]), ("e", [])])
    b = tree([("b", [("d", [])]), ("a", []), ("e", [])])
    assert sorted(x.tag for x, _ in wrapper.simple_tree_matching(a, b)) == ["b", "d", "e", "r"]


def test_alignment_is_simple_tree_matching():
    """On small random folded trees: as large as the general algorithm's match, keeping order and ancestors."""
    rng = random.Random(12)

    def made(depth=3):
        """A folded tree as places, and as the general algorithm's nodes."""
        places, shape, number = {}, wrapper.Shape("r"), iter(range(1, 1000))
        shape.index = 0

        def add(place, node, left):
            for tag in rng.sample("abcdef", rng.randint(0, 4)) if left else ():
                own = wrapper.crc32(tag.encode(), place)
                places[own] = place
                child = wrapper.Shape(tag)
                child.index = next(number)
                node.children.append(child)
                add(own, child, left - 1)

        add(0, shape, depth)
        return places, shape

    for _ in range(300):
        (a, x), (b, y) = made(), made()
        matched = wrapper.align(a, b)
        assert len(matched) == len(wrapper.simple_tree_matching(x, y))
        assert all(p == 0 or (a[p] == b[p] and a[p] in matched) for p in matched)
        for p in matched:
            orders = [[c for c, above in t.items() if above == p and c in matched] for t in (a, b)]
            assert orders[0] == orders[1]
        whole = wrapper.merge([(a, 2), (b, 1)])
        assert set(whole) == set(a) | set(b) and wrapper._unpacked(wrapper._packed(whole)) == whole
        assert wrapper.align(wrapper.merge([(a, 1)]), a) == {0, *a}
    deep = {i + 1: i for i in range(50_000)}
    assert len(wrapper.align(deep, deep)) == 50_001


def test_a_notice_in_another_order_is_another_node(spark):
    """Ten pages have a notice before the story; four have it behind, where it is aligned to nothing and stays; a host of few pages has no template."""
    pages = [(i, f"http://a.example/{i}", f"<body><section>Notice of the house</section><p>story {i} one</p></body>") for i in range(10)]
    pages += [(10 + i, f"http://a.example/{i}", f"<body><p>tale {i} two</p><section>Notice of the house</section></body>") for i in range(4)]
    pages += [(20, "http://b.example/", pages[0][2])]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    assert [got[i] for i in range(10)] == [f"story {i} one" for i in range(10)]
    assert [got[10 + i] for i in range(4)] == [f"tale {i} two Notice of the house" for i in range(4)] and got[20].startswith("Notice")
    assert wrapper.extract(spark.createDataFrame([], "page_id int, url string, html string")).collect() == []


def test_rare_trees_are_part_of_the_hosts_tree(spark):
    """64 trees of two pages each and 160 of one page: the notice stands in these alone, at one place, on over half of the pages."""
    tags = ["h1", "ul", "blockquote", "table", "pre", "dl", "center", "figure"]
    some = lambda i: "".join(f"<{t}>word {i} {t}</{t}>" for k, t in enumerate(tags) if i >> k & 1)
    pages = [(i, f"http://a.example/{i}", f"<body><div>{some(i % 64)}<p>story {i}</p></div></body>") for i in range(128)]
    pages += [(1000 + i, f"http://a.example/{i}", f"<body><div>{some(i)}<p>tale {i}</p></div><section>Notice</section></body>") for i in range(64, 224)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(pages, "page_id int, url string, html string").repartition(4)).collect()}
    assert got == {i: wrapper.main_text(p).removesuffix(" Notice") for i, _, p in pages}


def brute_aligned(pages, share=0.5, least=5):
    """``extract`` for one host without near copies, from the whole host's tree and the general alignment: html to text."""
    parsed = {p: wrapper.folded(wrapper.parse(p)) for p in pages}
    trees = Counter(tuple(tree.items()) for _, tree in parsed.values())
    whole = wrapper.merge([(dict(t), n) for t, n in trees.items()])
    votes, shapes, nodes = Counter(), Counter(), {}
    for p, (found, tree) in parsed.items():
        matched, form = wrapper.align(tree, whole), tuple(tree.items())
        nodes[p] = [(b.path if b.path in matched else (form, b.path), b.text) for b in found]
        shape = frozenset(b.path for b in found)
        shapes.update((None, shape))
        votes.update((by, n) for by in (None, shape) for n in set(nodes[p]))
    template = {n for (by, n), v in votes.items() if v >= max(least, share * shapes[by])}
    return {p: " ".join(b.text for b, n in zip(found, nodes[p], strict=True) if n not in template) for p, (found, _) in parsed.items()}


def test_alignment_of_many_trees_matches_brute_force(spark):
    rng = random.Random(8)
    tags = ["h1", "ul", "blockquote", "table", "pre", "dl", "center", "div"]

    def made(i, left=2):
        held = sorted(rng.sample(tags, rng.randint(1, 4)), key=lambda t: tags.index(t) + rng.choice((0, 0, 0, 5)))
        below = "".join(f"<{t}>{f'{t} house' if rng.random() < 0.7 else f'{i} {rng.random()}'}{made(i, left - 1) if left and t in ('div', 'table') else ''}</{t}>" for t in held)
        return below + f"<p>a story of its own, much longer than what pages of the house share, however many of them there are in all: {i} {rng.random()}</p>" * (left == 2)

    pages = [f"<body>{made(i)}</body>" for i in range(400)]
    wanted = brute_aligned(pages)
    trees = [wrapper.folded(wrapper.parse(p))[1] for p in pages]
    whole = wrapper.merge([(t, 1) for t in trees])
    assert len({tuple(t.items()) for t in trees}) > 128 and sum(len(wrapper.align(t, whole)) <= len(t) for t in trees) > 50
    assert sum(wrapper.main_text(p) != wanted[p] for p in pages) > 200
    rows = [(i, f"http://a.example/{i}", p) for i, p in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(4)).collect()}
    assert got == {i: wanted[p] for i, _, p in rows}


# media


def test_media_round_trip(spark, docs, corpus):
    path = text.scratch(spark, "media-test")
    media.store_texts(docs, path)
    for options in ({}, {"rangeBytes": "3000"}):
        rows = media.media_features(spark, path, **options).collect()
        assert len(rows) == len(corpus)
        got = {int(r["name"]): r for r in rows}
        for i, t in corpus:
            raw = (t or "").encode()
            payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
            r = got[i]
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
            assert r["media_sha256"] == hashlib.sha256(media.to_png(payload)).hexdigest() and r["feature"] == media.feature(payload)


def test_media_edges(spark, odd, none):
    path = text.scratch(spark, "media-odd")
    media.store_texts(odd, path)
    assert sorted(r["name"] for r in media.media_features(spark, path).collect()) == ["", "", "3", "3", "4", "5"]
    empty = text.scratch(spark, "media-none")
    media.store_texts(none, empty)
    assert media.media_features(spark, empty).count() == 0


def test_media_retries_one_member(monkeypatch, tmp_path):
    reader = media.ArchiveReader({"path": str(tmp_path), "tries": "3"})

    class Flaky:
        def __init__(self):
            self.reads = 0

        def open_input_file(self, path):
            return self

        def seek(self, at):
            pass

        def read(self, n):
            self.reads += 1
            if self.reads < 3:
                raise OSError("lost")
            return b"x" * n

    flaky = Flaky()
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    assert reader.payload(flaky, flaky, "f", 0, 4)[0] == b"xxxx"
    flaky.reads = -9
    with pytest.raises(media.MemberError):
        reader.payload(flaky, flaky, "f", 0, 4)
    with pytest.raises(ValueError):
        media.from_png(media.to_png(b"a" * 576)[:-20] + b"0" * 20)


# repetition


def brute_repetition(t):
    words = WORD.findall(t)
    triples = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(triples)
    covered = {i + k for i, g in enumerate(triples) if counts[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_repetition_counts(docs, corpus):
    got = by_id(repetition.repetition(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, t in corpus:
        want = brute_repetition(t or "")
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[i][:6] == (*want, failed)
        assert not (failed and got[i][6])


def test_repetition_edges(odd, none):
    rows = repetition.repetition(odd).collect()
    assert len(rows) == 6 and all(r["base_failed"] and not r["kept"] for r in rows)
    assert repetition.repetition(none).count() == 0


# classifier


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(3)
    good = [f"g{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        kind = i % 4
        words = [rng.choice(good) for _ in range(rng.randint(20, 80))]
        if kind == 1:
            words = [w + "!!" if rng.random() < 0.8 else w for w in words]
        if kind == 2:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty", "rotten"]))
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            labels.append((i, int(kind != 1), int(kind == 2)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_importance_separates_held_out_documents(judged):
    docs, labels = judged
    rows = importance.importance_resample(docs, labels, carry=["doc_id"]).collect()
    share = {k: np.mean([r["kept"] for r in rows if r["doc_id"] % 4 == k and r["doc_id"] % 3]) for k in range(4)}
    assert share[0] > 0.9 and share[3] > 0.9 and share[1] < 0.05 and share[2] < 0.2


def test_importance_matches_brute_force(spark, judged):
    """Counts by a dictionary, weights and noise by plain sums, the k largest by sorting."""
    docs, labels = judged
    cfg = importance.ImportanceConfig(bits=16)
    texts = dict(map(tuple, docs.collect()))
    target, held = importance._labelled(labels, (F.col("quality") == 1) & (F.col("toxic") == 0), cfg)

    def grams(t):
        words = re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+|[^\s0-9A-Za-z_\x80-\U0010ffff]+", t.lower())
        return [("w", w) for w in words], [("p", *p) for p in zip(words, words[1:], strict=False)]

    buckets = {}
    def bucket(g):
        if g not in buckets:
            _, ((w, _), (p, _)) = importance._features(pa.array([" ".join(g[1:])]), cfg.bits)
            buckets[g] = int(w[0] if g[0] == "w" else p[0])
        return g[0], buckets[g]

    cut = {i: [[bucket(g) for g in part] for part in grams(t)] for i, t in texts.items()}
    raw, good = [Counter() for _ in range(2)], [Counter() for _ in range(2)]
    for i, parts in cut.items():
        for k, part in enumerate(parts):
            raw[k].update(part)
            good[k].update(part if i in target else ())
    def ratio(k, b, prior):
        return np.log((good[k][b] + prior) / (raw[k][b] * sum(good[k].values()) / sum(raw[k].values()) + prior))
    weight, doubt = {}, {}
    for i, (words, pairs) in cut.items():
        rs = [ratio(0, b, cfg.prior_words) for b in words]
        weight[i] = sum(rs) + sum(ratio(1, b, cfg.prior_pairs) for b in pairs)
        doubt[i] = sum(max(-r - cfg.sure, 0) for r in rs) / (len(rs) + cfg.calm)
    limit = np.quantile([doubt[i] for i in held], cfg.keep_plain)
    k = sum(w >= np.quantile([weight[i] for i in held], 1 - cfg.keep_clean) for w in weight.values())
    noise = dict(zip(texts, importance.gumbel(np.array(list(texts)), cfg.seed), strict=True))
    best = sorted(texts, key=lambda i: -(weight[i] + noise[i]))[:k]
    rows = importance.importance_resample(docs, labels, carry=["doc_id"], cfg=cfg).collect()
    assert all(r["weight"] == pytest.approx(weight[r["doc_id"]], abs=1e-6) and r["perturbed"] == pytest.approx(r["weight"] + noise[r["doc_id"]]) for r in rows)
    assert all(r["doubt"] == pytest.approx(doubt[r["doc_id"]], abs=1e-9) for r in rows)
    assert {r["doc_id"] for r in rows if r["kept"]} == {i for i in best if doubt[i] <= limit + 1e-12}


def test_importance_long_texts_ties_and_repeated_rows(spark, judged):
    docs, labels = judged
    rows = [tuple(r) for r in docs.collect()]
    long = " ".join(t for i, t in rows if i % 4 in (0, 3) and i < 120)
    twice = docs.union(docs).union(spark.createDataFrame([(10**6, long), (10**6 + 1, long + " vile nasty rotten" * 100), (None, long)], docs.schema))
    got = {}
    for r in importance.importance_resample(twice, labels).collect():
        got.setdefault((r["doc_id"], len(r["text"])), []).append((r["weight"], r["perturbed"], r["doubt"], r["kept"]))
    assert sum(map(len, got.values())) == 2 * len(rows) + 3
    assert all(len(set(x)) == 1 for x in got.values())  # rows that repeat go together, those that tie at the last place too
    assert got[10**6, len(long)][0][3] and got[None, len(long)][0][3]
    assert not [x for (i, _), x in got.items() if i == 10**6 + 1][0][0][3]


def test_gumbel_top_k_samples_in_proportion():
    """Over many seeds, one of four documents is drawn as often as its weight says."""
    weights = np.array([1.0, 2.0, 3.0, 4.0])
    ids = np.arange(4)
    drawn = Counter(int(np.argmax(np.log(weights) + importance.gumbel(ids, seed))) for seed in range(20_000))
    assert all(abs(drawn[i] / 20_000 - weights[i] / 10) < 0.015 for i in range(4))


def test_importance_edges(spark, judged, odd, none):
    docs, labels = judged
    assert all(r["kept"] for r in importance.importance_resample(odd, labels.where("false")).collect())
    assert importance.importance_resample(none, labels).count() == 0
    mixed = odd.select("doc_id", "text", "kept").unionByName(docs.withColumn("kept", F.lit("x")))
    out = importance.importance_resample(mixed, labels)
    assert out.count() == 1206 and dict(out.dtypes)["kept"] == "boolean"
    clash = docs.limit(50).withColumns({"held": F.lit(1), "_text": F.lit("x"), "a.b": F.lit(2)})
    out = importance.importance_resample(clash, labels)
    assert out.columns == ["doc_id", "text", "held", "_text", "a.b", "weight", "perturbed", "doubt", "kept"] and out.where("`a.b` = 2 and held = 1").count() == 50


def test_kth_largest(spark):
    values = [float(i % 977) for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 17, 2500, 4999, 5000):
        assert importance.kth_largest(df, "v", k, exact_below=50) == ordered[k - 1]
    assert importance.kth_largest(df, "v", 0) == float("inf")


# near duplicates


def brute_components(rows, n):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_match_brute_force(docs, corpus, n):
    got = by_id(neardup.near_duplicates(docs, cfg=neardup.NearDupConfig(shingle=n)), "n_shingles", "component_id", "kept")
    assert got == brute_components(corpus, n)


def test_near_duplicates_of_a_family(spark):
    """Copies of one base that are like it but not like each other, others a little too far, and chains."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(150)]
    rows = [(900, " ".join(base))]
    for i in range(120):
        w = list(base)
        for k in rng.sample(range(150), rng.randint(3, 14)):
            w[k] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    chain = list(base)
    for i in range(15):
        chain[i * 9] = f"c{i}"
        rows.append((1000 + i, " ".join(chain)))
    got = by_id(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), cfg=neardup.NearDupConfig(shingle=2)), "n_shingles", "component_id", "kept")
    assert got == brute_components(rows, 2)


def test_near_duplicates_edges(odd, none):
    rows = neardup.near_duplicates(odd).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows) == [(0, 0, True), (0, 0, True), (3, 3, True), (3, 3, True), (4, 4, True), (5, 5, True)]
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    """Each text of a repeated id keeps its own links, and the other columns stay."""
    rng = random.Random(11)
    a, b, c = ([rng.choice("abcdefghij") + str(rng.randrange(1000)) for _ in range(200)] for _ in range(3))
    like = lambda w, i: " ".join([*w[:-1], f"new{i}"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, like(a, 1)), (3, like(b, 2)), (0, " ".join(c)), (1, " ".join(c)), (1, "alone")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, gone_id string, `a.b` int")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (1, 0, False), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
    left = neardup.without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == sorted([rows[0], rows[1], rows[4], rows[6]])


def test_near_duplicates_of_families_that_meet_by_chance(spark):
    """With few rows in a band, buckets hold members that are far from the pivot; links between those stay."""
    rng = random.Random(12)
    rows = []
    core = [f"k{i}" for i in range(60)]
    for f in range(12):
        own = [f"f{f}x{i}" for i in range(rng.randint(30, 90))]
        for j in range(rng.randint(1, 12)):
            w = core + own
            for k in rng.sample(range(len(w)), rng.randint(0, 9)):
                w[k] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    cfg = neardup.NearDupConfig(shingle=2, bands=60, rows=2)
    got = by_id(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), cfg=cfg), "n_shingles", "component_id", "kept")
    assert got == brute_components(rows, 2)


def test_sketch_agreement_is_the_similarity():
    rng = np.random.default_rng(0)
    keys = text.mix(rng.integers(0, 2**63, 1500).astype(np.uint64))
    a, b = np.sort(keys[:1100]), np.sort(keys[400:])
    both = neardup.sketch(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 2000, 1)
    assert not (both == neardup._NONE).any()
    assert abs((both[0] == both[1]).mean() - 700 / 1500) < 0.05
    alone = neardup.sketch(b, np.zeros(len(b), int), 1, 2000, 1)
    assert (alone[0] == both[1]).all()
    tiny = neardup.sketch(keys[:1], np.zeros(1, int), 1, 240, 1)
    assert not (tiny == neardup._NONE).any()


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 102), (102, 101), (7, 7)]
    got = {r["id"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


# personal data


def luhn(s):
    d = [int(c) for c in s[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_pii_base_spans(docs, corpus):
    rng = random.Random(9)
    alphabet = "a1@.+- (9)0%_b2é\n"
    extra = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    for t in [*(t or "" for _, t in corpus), *extra, "a@b@c.d.e@f.g", "1.2.3.4.5.6.7.8", "+1+23456789012", "4111111111111111 4111111111111112"]:
        base = [(k, a, b) for k, a, b, _ in pii.find(t) if pii.KINDS.index(k) < 4]
        assert base == brute_pii(t), t
    got = by_id(pii.span_digests(docs), "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    for i, t in corpus:
        want = brute_pii(t or "")
        said = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert got[i] == (*[sum(x[0] == k for x in want) for k in pii.KINDS[:4]], said)


def test_pii_validators_and_context():
    kinds = lambda t: [k for k, *_ in pii.find(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == ["iban"] and kinds("DE88 3704 0044 0532 0130 00") == []
    assert kinds("my SSN is 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("token = 0123456789abcdef0123456789abcdef") == ["secret"] and kinds("x 0123456789abcdef0123456789abcdef") == []
    assert pii.redacted("to a@b.co now", pii.find("to a@b.co now")) == "to <email> now"


def test_pii_ibans_end_where_they_should():
    def spans(text, kind="iban"):
        return [text[a:b] for k, a, b, _ in pii.find(text) if k == kind]

    de, gb = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    assert spans(f"IBAN {de} BIC COBADEFFXXX") == [de] and spans(f"{gb} A note") == [gb] and spans(f"AB12 {de} 7 {gb}") == [de, gb]
    assert spans(de.replace(" ", "") + " EUR 100") == [de.replace(" ", "")] and spans(f"{de}1 A") == spans(f"{de}A") == spans(f"X{de}") == []
    rest = "0" * 14 + "7"
    zz = next(f"ZZ{n:02} {rest}" for n in range(2, 99) if pii.mod97(f"ZZ{n:02}{rest}"))  # no such country
    assert spans(zz + " XXXX") == [zz] and pii.redacted(zz + " OK", pii.find(zz + " OK")) == "<iban> OK"
    for n in (31, 32, 512, 513, 100_000):
        assert spans(f"token={'a' * (n - 1)}1 end", "secret") == (["a" * (n - 1) + "1"] if n > 31 else [])


def test_pii_edges(odd, none):
    assert pii.redact_pii(odd).columns == odd.columns and pii.find_pii(odd).count() == 6
    assert [r["text"] for r in pii.redact_pii(odd).where("doc_id = 4").collect()] == [None]
    assert pii.find_pii(none).count() == 0
    long = "9" * 60_000 + "@" + "a" * 60_000
    assert pii.find(long) == []


# line dedup


def brute_lines(rows, min_docs):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    counts = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if counts[key(x)] < min_docs]
        out[i] = (None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept))
    return out


@pytest.mark.parametrize("least,shard,most", [(10, 20_000, 32 << 20), (2, 3, 100)])
def test_line_dedup_matches_brute_force(docs, corpus, least, shard, most):
    """Also where the index goes to the documents in several parts."""
    got = by_id(linededup.line_dedup(docs, min_docs=least, keys_per_shard=shard, index_bytes=most), "text", "n_lines", "n_dropped")
    assert got == brute_lines(corpus, least)


def test_line_dedup_edges(spark, odd, none):
    rows = linededup.line_dedup(odd, min_docs=3).collect()
    assert sum(r["n_dropped"] for r in rows) == 3 and all(r["text"] == "" for r in rows if r["n_dropped"])
    assert rows[0]["kept"] in ("k", "z", None) and linededup.line_dedup(none).count() == 0
    # repeated ids are documents of their own; odd column names pass
    same = spark.createDataFrame([(1, "x\nown", 1, 2, 3), (1, "X ", 1, 2, 3), (2, "é\n\n", 1, 2, 3)], "doc_id long, text string, marks int, `a.b` int, `n lines` int")
    got = linededup.line_dedup(same, min_docs=2)
    assert got.columns == [*same.columns, "n_lines", "n_dropped"]
    assert sorted((r["text"], r["n_lines"], r["n_dropped"], r["marks"], r["a.b"]) for r in got.collect()) == [("", 1, 1, 1, 2), ("own", 2, 1, 1, 2), ("é\n\n", 3, 0, 1, 2)]
    assert sorted(r["n_dropped"] for r in linededup.line_dedup(same, min_docs=1, min_chars=2).collect()) == [0, 0, 1]


def test_perfect_hash_is_minimal():
    keys = text.mix(np.arange(5000, dtype=np.uint64))
    levels = linededup.build_mph(keys)
    assert sorted(linededup.probe_mph(levels, keys).tolist()) == list(range(5000))
    strangers = linededup.probe_mph(levels, text.mix(np.arange(10_000, 12_000, dtype=np.uint64)))
    assert strangers.max() < 5000
    with pytest.raises(ValueError):
        linededup.build_mph(np.array([1, 1], np.uint64))


# token counts and sentencepiece


@pytest.fixture(scope="module")
def reference():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def test_token_counts_and_cache(spark, docs, corpus, reference):
    cache = text.scratch(spark, "cache-test")
    model = P.path("piece_bpe_32k.model")
    got = by_id(tokencount.token_counts(docs, model, cache), "n_bytes", "n_tokens", "over_limit")
    for i, t in corpus:
        n = len(reference.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 4096)
    distinct = len({t or "" for _, t in corpus})
    assert spark.read.parquet(cache).count() == distinct
    more = docs.limit(20).unionByName(spark.createDataFrame([(999, "brand new")], "doc_id long, text string"))
    assert tokencount.token_counts(more, model, cache).count() == 21
    assert spark.read.parquet(cache).count() == distinct + 1


def test_token_counts_edges(spark, odd, none):
    model = P.path("piece_bpe_32k.model")
    rows = tokencount.token_counts(odd, model, text.scratch(spark, "cache-odd")).collect()
    assert len(rows) == 6 and all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (4, 5)) and "kept" in rows[0]
    assert tokencount.token_counts(none, model, text.scratch(spark, "cache-none")).count() == 0


def test_sentencepiece_round_trip(docs, corpus, reference):
    model = P.path("piece_bpe_32k.model")
    rows = {r["doc_id"]: r for r in spm.decode(spm.encode(docs, model), model).collect()}
    for i, t in corpus:
        ids = reference.encode(t or "")
        assert rows[i]["ids"] == ids and rows[i]["parity"] and rows[i]["decoded"] == reference.decode(ids)
    out = spm.decode(spm.encode(docs, model), model, digest=True).where("doc_id = 0").first()
    assert out["n_tokens"] == len(reference.encode(corpus[0][1])) and out["ids_crc32"] == zlib.crc32(np.array(reference.encode(corpus[0][1]), "<u4").tobytes())


def test_sentencepiece_there_and_back_is_encoding_and_decoding(docs, odd, none):
    model = P.path("piece_bpe_32k.model")
    for df in (docs, odd, none, odd.withColumn("n_tokens", F.lit("x"))):
        two, one = spm.decode(spm.encode(df, model), model, digest=True), spm.there_and_back(df, model)
        assert sorted(one.columns) == sorted(two.columns)
        assert sorted(map(str, one.select(two.columns).collect())) == sorted(map(str, two.collect()))


def test_sentencepiece_backend_alone(corpus, reference):
    """The rebuilt pipeline by itself, on whole texts, gives the library's ids and the table's text."""
    model = spm.read_model(P.path("piece_bpe_32k.model"))
    backend, table = spm.build(model), spm.Decoder(model)
    texts = [t for _, t in corpus if t and len(t) < 10_000]
    for t, found in zip(texts, backend.encode_batch(texts, add_special_tokens=False), strict=True):
        assert found.ids == reference.encode(t)
        assert backend.decode(found.ids, skip_special_tokens=False) == table.decode(np.array(found.ids, np.uint32)) == reference.decode(found.ids)


def test_sentencepiece_decodes_odd_ids(spark, reference):
    """Control pieces, bytes that are no text, unknown pieces, and ids that begin within a part, as the library decodes them."""
    path = P.path("piece_bpe_32k.model")
    model = spm.read_model(path)
    byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == spm.BYTE}
    control = [i for i, (*_, kind) in enumerate(model.pieces) if kind == spm.CONTROL]
    plain = reference.encode("some plain text, twice  over")
    rows = [[], plain[1:], [*control[:1], *plain], [byte[0xE6], byte[0x97], byte[0xA5], *plain], [*plain, byte[0xFF], byte[0x41]], reference.encode("  two ▁ marks "), None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in spm.decode(df, path).collect()}
    assert got == {i: None if r is None else reference.decode(r) for i, r in enumerate(rows)}


def test_sentencepiece_unigram_is_rebuilt():
    def field(n, kind, data):
        return bytes([n << 3 | kind]) + data

    def piece(p, score, kind=1):
        import struct

        raw = p.encode()
        body = field(1, 2, bytes([len(raw)]) + raw) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        return field(1, 2, bytes([len(body)]) + body)

    data = piece("<unk>", 0.0, 2) + piece("▁a", -1.0) + piece("b", -2.0) + piece("▁ab", -2.5) + field(2, 2, bytes([2]) + field(3, 0, b"\x01"))
    model = spm.parse_model(data)
    assert not model.bpe and model.unknown == 0 and spm.build(model).encode("ab a", add_special_tokens=False).ids == [3, 1]


def test_sentencepiece_edges(odd, none):
    model = P.path("piece_bpe_32k.model")
    rows = spm.decode(spm.encode(odd, model), model).collect()
    assert len(rows) == 6 and all(r["ids"] == [] and r["decoded"] == "" for r in rows if not r["text"])
    assert spm.encode(none, model).count() == 0


# text kernels


def test_words_and_lines_across_batches():
    column = pa.array(["a  b\nc", None, "", "\n\n", "x" * 10, "ünï cödé"])
    t = text.Text(column)
    assert t.n_words.tolist() == [3, 0, 0, 0, 1, 2]
    _, _, doc = t.lines()
    assert Counter(doc.tolist()) == {0: 2, 1: 1, 2: 1, 3: 3, 4: 1, 5: 1}
    alone = text.Text(pa.array(["zz ünï"]))
    assert alone.words()[1] == t.words()[4]
    assert list(text.slices(column, most=8)) == [(0, 4), (4, 5), (5, 6)] and list(text.slices(pa.array([], pa.string()))) == []
