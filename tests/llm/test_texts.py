"""Kernel, tokenizers, packing, files, decontamination and HTML: against definitions, round trips and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from stemforge.llm import count_tokens, decontaminate, html_text, pack, pretokens, rans
from stemforge.llm import kernel as K
from stemforge.llm.shared import scratch

public = pytest.importorskip("public_tokenizers")
HARD = [
    "", None, "   ", "\n", "Don't you're we'll 'tis  it's\n\n  x 's 'S 're'd'll", "a  b   \n\t c ", "日本語 テスト 123abc½ ①", "<|endoftext|>hi<|endoftext|> there <|endo",
    "''s '''s !'s", "a" * 3000 + " " * 500, "😀👍🏽 x", "İstanbul é", "x<|startoftext|>y", "a\x85b\xa0c", "ⅣⅤ Ⓐb", "éèê'ré 'r", "THE!! end.",
]


def texts(n=150, seed=5):
    rng = random.Random(seed)
    return HARD + ["".join(rng.choice("ab st'rvelmd  \n\t12.!é日 ") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(parts)


def test_words():
    x = texts()
    w = K.Words(pa.array(x))
    want = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in x]
    assert w.count.tolist() == [len(v) for v in want]
    assert [w.string(i) for i in range(len(w))] == [v for ws in want for v in ws]
    by_hash = {}
    for i in range(len(w)):
        assert by_hash.setdefault(int(w.hash[i]), w.string(i)) == w.string(i)
    assert len(by_hash) == len({v for ws in want for v in ws})


def test_words_slice_and_batches():
    b = pa.record_batch([pa.array(["aa bb", "cc", None, "dd ee ff"])], ["text"])
    assert K.Words(b.slice(1).column(0)).count.tolist() == [1, 0, 3]
    parts = list(K.batches([b], most=4))
    assert [p.num_rows for p in parts] and sum(p.num_rows for p in parts) == 4


def test_shingle_sets():
    s = K.shingle_sets(K.Words(pa.array(["a b c d e", "a b", "", "A B C D E", "a b c d a b c d"])), 4)
    assert [len(v) for v in s] == [2, 1, 0, 2, 4]
    assert (s[0] == s[3]).all()


def test_counts_like_the_library():
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    lib, own, x = Tokenizer.from_file(path), count_tokens.TextCounter(path), texts()
    assert own.rows(pa.array(x)).tolist() == [len(lib.encode(t or "", add_special_tokens=False).ids) for t in x]


def test_special_strings_and_long_words_like_the_library(spark):
    """Special strings within a text only, whatever else it holds; pretokens of any length; all through the query's own operator."""
    from tokenizers import Tokenizer

    path, rng = public.path("byte_bpe_50k.json"), random.Random(2)
    lib = Tokenizer.from_file(path)
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(of) for _ in range(n))
    x = ["<|endof", "text|>", "<|endof<|endoftext|>text|>", "a\0\0mark\0\0b <|endoftext|>", "<|endoftext|>" * 3 + "x", None, "", "<|endoftext|>", letters(5000), "a" * 100_000, " " * 70_000, "ab" * 40_000 + "c", "the" * 30_001]
    x += ["日本" * 20_000, "=" * 77_777 + "-" * 10_001, letters(66_000, "thernig"), "".join(rng.choice(["th", "er", "ing", "un", "ness"]) for _ in range(20_000)), "word " * 20_000]
    rows = [(i, t, True) for i, t in enumerate(x)] + [(None, "null id", True), (3, "again", True), (3, "again", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens boolean").repartition(2)
    got = sorted((tuple(r) for r in count_tokens.count_tokens(docs, path, limit=512).collect()), key=str)
    n = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((i, len((t or "").encode()), n(t), n(t) > 512) for i, t, _ in rows), key=str)


def test_token_counts_of_nothing(spark):
    assert count_tokens.count_tokens(frame(spark, []), public.path("byte_bpe_50k.json")).count() == 0


def test_chunk_maps_compose():
    """However a long pretoken is cut, its count is that of one walk."""
    own = count_tokens.TextCounter(public.path("byte_bpe_50k.json")).counter
    rng = np.random.default_rng(4)
    for data in (rng.choice(list(b"etaoin"), 3000), np.tile(list(b"abc"), 900), np.full(2000, 0x61), rng.integers(0, 256, 2500)):
        data = data.astype(np.uint8)
        want = own.walk(data.tobytes(), 0)[1]
        for own.CHUNK, own.WARM, own.SECTION in (256, 64, 1 << 16), (64, 0, 500), (100, 3, 1000):
            assert own.long(data) == want


def test_counting_survives_a_restart_of_the_transducer():
    path = public.path("byte_bpe_50k.json")
    own = count_tokens.TextCounter(path)
    x = pa.array(texts(30))
    first = own.rows(x).tolist()
    own.counter.most, own.memo.most = 5, 3
    assert own.rows(x).tolist() == first == own.rows(x).tolist()


def test_transducer_chunks_do_not_matter():
    t = pretokens.Transducer()
    sym = np.random.default_rng(0).integers(0, 12, 5000).astype(np.uint8)
    assert (t.run(sym, 7) == t.run(sym, 64)).all() and (t.run(sym, 5000) == t.run(sym, 64)).all()


def test_ids_like_the_library():
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    lib, own, x = Tokenizer.from_file(path), pretokens.WordIds(path), texts()
    ids, off = own.encode(pa.array(x))
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [lib.encode(t or "", add_special_tokens=False).ids for t in x]


@pytest.mark.parametrize("tokens,segments,loss", [(2048, 256, None), (64, 3, None), (64, 256, 20)])
def test_packing(spark, tokens, segments, loss):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    lib, x = Tokenizer.from_file(path), texts(300)
    rows = pack.pack(frame(spark, x), path, tokens=tokens, segments=segments, loss=loss).collect()
    ids = [np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in x]
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(x)))
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(ids[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[d])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= tokens and len(pieces) <= segments and sum(r.loss_tokens for r in pieces) <= (loss or tokens)


def test_packing_of_prompts(spark):
    """Tokens of prompts bear no loss, and a loss limit below the token limit binds: sequences of answers hold more prompt."""
    from pyspark.sql import functions as F

    path, rng = public.path("word_bpe_49k.json"), random.Random(3)
    rows = [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randint(1, 90))), rng.choice([0, 5, 20, 200, None])) for i in range(200)] + [(None, "again a row", 1), (7, "again a row", 1), (7, "again a row", 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, silent int, length string").repartition(2)
    got = pack.pack(docs, path, tokens=64, segments=8, loss=24, prompt=F.col("silent")).collect()
    silent = {i: n or 0 for i, _, n in rows}
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
        if r.doc_id != 7:
            assert r.loss_tokens == max(0, r.start + r.length - max(r.start + 1, silent[r.doc_id]))
    sums = [tuple(map(sum, zip(*((r.length, 1, r.loss_tokens) for r in pieces), strict=True))) for pieces in by_seq.values()]
    assert all(t <= 64 and n <= 8 and v <= 24 for t, n, v in sums) and max(v for _, _, v in sums) == 24 and max(t for t, _, _ in sums) > 50
    assert sum(r.length for r in got) == sum({(r.doc_id, i): r.doc_tokens for i, r in enumerate(got) if r.start == 0}.values())


def test_packing_of_nothing(spark):
    assert pack.pack(frame(spark, []), public.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 33, 1000, rans.BLOCK + 5])
def test_rans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).geometric(0.001, n), 49407).astype(np.uint32)
    t = rans.Table(np.bincount(ids, minlength=49408))
    assert t.freq.sum() == 1 << rans.BITS and t.freq.min() >= 1
    content = rans.write_file(t, 7, [5, None], np.array([n // 2, n - n // 2]), ids)
    base, docs, sizes, back = rans.read_file(t, content)
    assert (base, docs, sizes.tolist()) == (7, [5, None], [n // 2, n - n // 2]) and (back == ids).all()


def test_rans_damage_is_found():
    ids = np.arange(5000, dtype=np.uint32) % 300
    t = rans.Table(np.bincount(ids, minlength=49408))
    content = bytearray(rans.write_file(t, 0, [1], np.array([5000]), ids))
    for at in (0, 30, len(content) - 5):
        bad = bytearray(content)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            rans.read_file(t, bytes(bad))


def test_token_files(spark):
    from tokenizers import Tokenizer

    path, x = public.path("word_bpe_49k.json"), texts(60)
    to = scratch(spark, "test")
    rans.write_ids(spark, frame(spark, x), path, to, file_ids=500)
    lib, start = Tokenizer.from_file(path), 0
    for d, r in enumerate(rans.read_ids(spark, to).orderBy("doc_id").collect()):
        ids = np.array([*lib.encode(x[d] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_keep_repeats_null_ids_and_long_texts(spark):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    rows = [(5, "b b"), (5, "a"), (5, "a"), (None, "null id"), (2, "word " * 50_000), (9, None), (9, "")]
    docs = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, ids binary").repartition(3)
    to = scratch(spark, "test")
    rans.write_ids(spark, docs, path, to, file_ids=20_000)
    lib = Tokenizer.from_file(path)
    ids = lambda t: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    got = sorted(rans.read_ids(spark, to).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 2, 5, 5, 5, 9, 9] and [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((i or 0, len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t in rows)


def test_ids_beyond_two_bytes():
    assert rans.width(49_408) == rans.width(1 << 16) == "<u2" and rans.width((1 << 16) + 1) == "<u4"
    ids = np.array([70_000, 3, 99_999, 70_000], np.uint32)
    t = rans.Table(np.bincount(ids, minlength=100_000))
    assert (rans.read_file(t, rans.write_file(t, 0, [1], np.array([4]), ids))[3] == ids).all()


def test_token_files_of_nothing(spark):
    to = scratch(spark, "test")
    rans.write_ids(spark, frame(spark, []), public.path("word_bpe_49k.json"), to)
    assert rans.read_ids(spark, to).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items, span=10):
    items = [(i, WORD.findall(lower(t))) for i, t in items]
    out = []
    for d in docs:
        w, hit, found = WORD.findall(lower(d)), set(), set()
        for i, v in items:
            n = min(span, len(v))
            grams = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if v else set()
            for j in range(len(w) - n + 1 if v else 0):
                if tuple(w[j : j + n]) in grams:
                    hit.update(range(j, j + n))
                    found.add(str(i))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_decontamination(spark, block):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("abcde") + str(rng.randint(0, 3)) for _ in range(n))) for i, n in enumerate([30, 12, 10, 9, 3, 1, 40, 0])] + [(90, None), (91, "a0 " * 15)]
    docs = ["", None, items[4][1], "x " + items[0][1][:70] + " y", "A0 " * 25]
    for _ in range(60):
        parts = [" ".join(rng.choice("abcde") + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 30)))]
        if rng.random() < 0.6:
            v = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(v) - 5))
            parts.append(" ".join(v[a : a + rng.randint(5, 20)]).upper())
        docs.append(", ".join(parts))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.decontaminate(spark, frame(spark, docs), b, block_bytes=block).collect()}
    want = brute_hits(docs, items)
    assert [got[i] for i in range(len(docs))] == want
    kept = {r.doc_id for r in decontaminate.clean_documents(spark, frame(spark, docs), b, block_bytes=block).collect()}
    assert kept == {i for i, r in enumerate(want) if not r[4]}


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_decontamination_of_repeats(spark, block):
    """Repeated words against repeated words, very long texts, clashing columns, repeated rows and null ids."""
    items = [("i1", "ab cd " * 400), ("i2", "x " * 500), ("i3", "ab"), (None, "null id here"), ("i1", "second text of the same id with ten words or more in it")]
    docs = ["ab cd " * 600, "cd ab " * 30, "x " * 3000, "y x " * 100, "null id here", "x " * 9 + "y"]
    rows = [(i, t, "q", 1) for i, t in enumerate(docs)] + [(1, docs[1], "q", 1), (None, "x " * 20, "q", 1), (50, None, "q", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string, `n.hit` int").repartition(3)
    b = spark.createDataFrame(items, "item_id string, text string")
    got = sorted((tuple(r) for r in decontaminate.decontaminate(spark, df, b, block_bytes=block).collect()), key=str)
    want = brute_hits([r[1] for r in rows], [(i, t) for i, t in items if i is not None])
    hidden = brute_hits(["null id here"], [("z", "null id here")])[0]
    want[4] = (*hidden[:2], 0, hashlib.sha256(b"").hexdigest(), True)  # marked, with no id to report
    assert got == sorted(((r[0], *v) for r, v in zip(rows, want, strict=True)), key=str)
    kept = decontaminate.clean_documents(spark, df, b, block_bytes=block)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r, v in zip(rows, want, strict=True) if not v[4])


def test_decontamination_of_long_repeats_is_fast():
    import time

    ix = decontaminate.Index(["1"], ["ab " * 20_000], 10, 5)
    begin = time.time()
    start, end, row, item = ix.hits(K.Words(pa.array(["ab " * 20_000]), K.ALNUM))
    assert (int(start.min()), int(end.max()), len(row)) == (0, 20_000, 1) and time.time() - begin < 5


def test_sieve_has_no_false_negative():
    h = K.mix(np.arange(1, 5000, dtype=np.uint64))
    sieve = decontaminate.Sieve(5000 * 16 // 64)
    sieve.add(h)
    assert sieve.has(h).all() and sieve.has(K.mix(np.arange(10_000, 60_000, dtype=np.uint64))).mean() < 0.01


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(spark, frame(spark, ["a b"]), none).collect()[0].n_hit == 0
    assert decontaminate.decontaminate(spark, frame(spark, []), none).count() == 0


LONG = "This is a sentence of the story, with commas, clauses and quite some words in it, as running text has. "


def test_html():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>bad</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
    <div class="ad">Buy &amp; sell</div><article><h1>Ti&eacute;tle &amp; more</h1><p>{LONG}<br>{LONG}<p>Short one.</p>
    <p>x &lt;b&gt;  y
    z</p><ul><li>one<li>two</ul><form><p>your name</p></form><aside>related</aside></article>
    <section id="comments"><p>{LONG}</p></section><footer>&copy; foot</footer></body></html>"""
    one = LONG.strip()
    assert html_text.main_text(page) == f"Tiétle & more\n{one} {one}\nShort one.\nx <b> y z\none\ntwo"


def test_html_degenerate():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<div></div>") == ""
    assert html_text.main_text("just  text") == "just text"
    assert html_text.main_text("<p>a<p>b") == "a\nb"
    assert html_text.main_text("<article><p>unclosed &lt;") == "unclosed <"
    assert html_text.main_text("<div>" * 5000 + "deep") == "deep"


@pytest.mark.parametrize(
    "page,text",
    [
        ("<p title=it's>first</p><p>don't stop</p><p>it's > end</p>", "first\ndon't stop\nit's > end"),
        ("<p a='x > y' b=\"<p>\" c>one</p><P\nclass=z >two</P >", "one\ntwo"),
        ("<p a='never ends>one</p><p>two</p>", "one\ntwo"),
        ("<p>a<svg><path d='x'><text>label</text><p>rest of the page</p><p>more</p>", "a\nrest of the page\nmore"),
        ("<p>a <svg><style/><title>t</title><foreignObject><div>in</div></foreignObject></svg> b</p>", "a b"),
        ("<p>Let <math><mi>x</mi><mo>+</mo><mi>y</mi><annotation>x+y</annotation></math> be.</p>", "Let x+y be."),
        ("<p>a<!-- b --!>c<!-->d<!--->e<!-- -- > -->f<!doctype x><?php y ?></ z>g", "acdefg"),
        ("<p>x <![CDATA[ y ]]> z</p><p><math><![CDATA[<b>]]></math></p>", "x z\n<b>"),
        ("<script>var x = '</scr' + 'ipt><p>no</p>'; </SCRIPT\n>ok<style>p</style></p><p>2", "ok\n2"),
        ("<xmp><b>raw</b></xmp><p>1 < 2 and 3 <4 &amp;amp; &lt;b&gt; &copy &#x41;", "<b>raw</b>\n1 < 2 and 3 <4 &amp; <b> © A"),
        ("<p>a <button>press</button> b<hr>c</p><p>last <i", "a b\nc\nlast"),
        ("<ul><li>one<ul><li>deep</ul><li>two</ul><dl><dt>t<dd>d<dt>u</dl><table><tr><td>1<td>2<tr><th>3</table>", "one\ndeep\ntwo\nt\nd\nu\n1\n2\n3"),
    ],
)
def test_html_by_the_standard(page, text):
    assert html_text.main_text(f"<body>{page}") == text


@pytest.mark.parametrize(
    "page,text",
    [
        ('<article><div class="entry-header"><h1>Title</h1></div><p>@</p></article><div class="sidebar"><p>x</p></div>', "Title\n@"),
        ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>@</p><footer>tags</footer></article>", "Title\n@"),
        ('<div class="page-with-sidebar"><h1>T</h1><p>@</p></div><div id="site-header">x</div><div class="ads">y</div>', "T\n@"),
        ('<div class="widget-page"><h1>T</h1><p>@</p><p>@</p></div><div class="post-comments"><p>@</p></div>', "T\n@\n@"),
    ],
)
def test_html_names(page, text):
    assert html_text.main_text(page.replace("@", LONG)) == text.replace("@", LONG.strip())


@pytest.mark.parametrize("part", ["<a x", "<p a='", "<!--", "<", "<title></p", "<script></b", "<a =", "&amp", "<div>", "<div><p>a, b</p>", "<li>", "<td>x<div>", "<div><li>x", "<table><tr><td>", "</p><div></section>", "<svg>", "<![CDATA["])
def test_html_in_linear_time(part):
    import time

    begin = time.time()
    html_text.main_text(part * (300_000 // len(part)) + '"')
    assert time.time() - begin < 10


def test_html_edges(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0
    page = "<article>" + f"<p>{LONG}</p>" * 10_000 + "</article>"
    got = html_text.extract(spark.createDataFrame([(None, None, page, "clash", "clash")], schema)).first()
    assert (got.page_id, got.url, got.text, got.n_chars) == (None, None, "\n".join([LONG.strip()] * 10_000), len(got.text))


def test_html_query(spark):
    rows = [(1, "u", "<p>a b</p>"), (2, None, None), (2, None, None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, "a b", 3), (2, "", 0), (2, "", 0)]
