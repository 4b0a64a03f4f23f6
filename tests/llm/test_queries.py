"""The registered queries, with production parameters on a whole table, against brute force; those with SQL are compared with it elsewhere."""

import hashlib
import re
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest

from floodgrid.llm import media, pii, queries, wrapper

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1_places_every_id_once(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in queries.op1_packing(spark, SF).collect():
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    for i, t in texts.items():
        ids, at = [*tokenizer.encode(t, add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 4096 or (at < 4096 and at & (at - 1) == 0)


def test_op2_gives_the_article(spark):
    """The pages of the table have one article each, with reader comments and forms outside of it."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op2_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]
        found = wrapper.blocks(wrapper.parse(pages[r["page_id"]]["html"] or ""))
        assert r["text"] == " ".join(b.text for b in found if b.within)


class Article(HTMLParser):
    """The texts of a page's articles by Python's own parser: a block tag ends a text, a break is a space."""

    BLOCKS = frozenset("article aside blockquote div dd dl dt figure footer form h1 h2 h3 h4 h5 h6 header li nav ol p pre section table td th tr ul".split())
    SKIPPED = frozenset("aside nav form footer script style noscript template button".split())

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.texts = 0, [], [""]
        self.feed(page)
        self.close()

    def said(self):
        return " ".join(filter(None, (" ".join(t.split()) for t in self.texts)))

    def handle_starttag(self, tag, attrs):
        named = set((dict(attrs).get("class") or "").split()) | {dict(attrs).get("id")}
        if tag in self.SKIPPED or named & {"ad", "comments", "comment", "share", "related"}:
            if tag not in ("br", "img", "input"):
                self.skip.append(tag)
        elif self.skip and tag == self.skip[-1]:
            self.skip.append(tag)
        self.inside += tag == "article"
        if tag in self.BLOCKS:
            self.texts.append("")
        elif tag == "br":
            self.texts[-1] += " "

    def handle_endtag(self, tag):
        if self.skip and tag == self.skip[-1]:
            self.skip.pop()
        self.inside -= tag == "article"
        if tag in self.BLOCKS:
            self.texts.append("")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.texts[-1] += data


def test_op2_equals_another_parser(spark):
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op2_html_extraction(spark, SF).collect():
        assert r["text"] == Article(pages[r["page_id"]]).said(), r["page_id"]


def test_op3_reads_back_what_it_stored(spark, texts):
    rows = {r["doc_id"]: r for r in queries.op3_media_columns(spark, SF).collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        raw, r = t.encode(), rows[i]
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert media.from_png(media.to_png(payload)) == payload and r["media_bytes"] > 0
    by_text = defaultdict(set)
    for i, t in texts.items():
        by_text[t].add((rows[i]["media_sha256"], rows[i]["media_bytes"], rows[i]["feature"]))
    assert all(len(v) == 1 for v in by_text.values())


def luhn(s):
    d = [int(c) for c in s[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_op7_base_spans(spark, texts):
    digits = lambda s: re.sub("[^0-9]", "", s)
    for r in queries.op7_pii(spark, SF).collect():
        t = texts[r["doc_id"]]
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
        out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
        out.sort(key=lambda x: (x[1], pii.KINDS.index(x[0])))
        said = [f"{k}:{a}:{b}" for k, a, b in out]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest() and set(said) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(x[0] == k for x in out) for k in pii.KINDS[:4]]


def test_op9_and_op10_give_the_library_s_ids(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ids = {i: model.encode(t) for i, t in texts.items()}
    counted = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op9_token_counts(spark, SF).collect()}
    assert counted == {i: (len(t.encode()), len(ids[i]), len(ids[i]) > 4096) for i, t in texts.items()}
    rows = {r["doc_id"]: r for r in queries.op10_sentencepiece(spark, SF).collect()}
    assert set(rows) == set(texts)
    for i, r in rows.items():
        assert (r["n_tokens"], r["ids_crc32"], r["parity"]) == (len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes()), True)
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids[i]).encode()).hexdigest()


def test_op5_keeps_good_documents(spark):
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op5_quality_classifier(spark, SF).collect()
    assert {"doc_id", "kept"} <= set(rows[0].asDict()) and len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    kept = {r["doc_id"]: r["kept"] for r in rows}
    good, bad = ([kept[i] for i, x in labels.items() if i in kept and (x == (1, 0)) is want and (want or x[0] == 0)] for want in (True, False))
    assert np.mean(good) >= 0.9 and np.mean(bad) <= 0.2
