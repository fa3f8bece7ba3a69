"""The operators against brute-force versions on small rows, with the odd cases."""

import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from statespan.llm import (
    chat, chunk_dedup, collocations, decontamination, html_text, jaccard_join, language, quality, segmentation, spelling, suffix_dedup, topk_search, warc,
)
from statespan.llm._common import components

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.5) for i, t in zip(ids, texts)], DOC)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 8))) for _ in range(n))


def corpus(seed=1, n=24):
    rng = random.Random(seed)
    passage = prose(rng, 60)
    texts = [None, "", "   \n\t", "one", "Two words", "a" * 700, "\n".join(["x y z"] * 40)]
    for k in range(n):
        t = prose(rng, rng.randint(5, 150))
        if k % 4 == 0:
            t = t[: len(t) // 2] + passage + t[len(t) // 2:]
        texts.append(t)
    base = prose(rng, 200)
    for _ in range(6):
        words = base.split(" ")
        for _ in range(4):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    return [*texts, base, base, base.upper(), texts[8]]


@pytest.mark.parametrize("size", [10**6, 10**9, 10**14])
def test_blocks_follow_the_bytes(spark, monkeypatch, size):
    """No block is due more than its bytes, 100 TB or not."""
    from statespan.llm import _common

    monkeypatch.setattr(_common, "input_bytes", lambda df: size)
    n = _common.n_blocks_of(spark.range(1), 4 << 20)
    assert n >= 4 * _common.n_parts(spark) and n * (4 << 20) >= size and (size < 10**9 or (n - 1) * (4 << 20) < size)


# -- 1 ------------------------------------------------------------------------

def removed_bytes(rows):
    seen, out = {}, {}
    rows = [(i, (t or "").encode()) for i, t in rows]
    order = lambda i: (1 << 63) if i is None else i
    for i, raw in sorted(set(rows), key=lambda r: (order(r[0]), r[1])):
        gone = bytearray(len(raw))
        for a in range(len(raw) - 99):
            w = raw[a: a + 100]
            if seen.setdefault(w, (i, a)) != (i, a):
                gone[a: a + 100] = b"\1" * 100
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i, len(raw)] = (sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("piece,heavy,collide", [(1 << 20, 20_000, False), (150, 20_000, False), (1 << 20, 2, False), (1 << 20, 20_000, True), (1 << 20, 2, True)])
def test_suffix_dedup_is_brute_force(spark, monkeypatch, piece, heavy, collide):
    """Also where long texts are cut, where every shared anchor is heavy and where hashes collide."""
    monkeypatch.setattr(suffix_dedup, "_PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
    if collide:  # few different hashes, each for very different bytes
        class Colliding(suffix_dedup.SpanHash):
            def __call__(self, starts, ends):
                return super().__call__(starts, ends) % np.uint64(7)

        monkeypatch.setattr(suffix_dedup, "SpanHash", Colliding)
    texts = corpus()
    found = suffix_dedup.repeated_spans(documents(spark, texts).selectExpr("*", "1 as d", "2 as h", "3 as runs", "4 as row")).collect()
    want = removed_bytes(list(enumerate(texts)))
    assert len(found) == len(texts)
    for r in found:
        assert (r.n_removed, len(r.spans), r.kept_sha256) == want[r.doc_id, r.n_bytes]


def test_suffix_dedup_odd_rows(spark):
    long = prose(random.Random(3), 80)
    rows = documents(spark, [long, long, long, None], [None, 5, 5, None])
    found = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.repeated_spans(rows).collect()}
    size = len(long.encode())
    assert found == {(5, size): 0, (None, size): size, (None, 0): 0}
    assert suffix_dedup.repeated_spans(rows.limit(0)).count() == 0


@pytest.mark.parametrize("tool", [suffix_dedup, chunk_dedup])
@pytest.mark.parametrize("ids", [[None] * 5, [5] * 5, [None, 5, 5, None, None]])
def test_dedup_tells_rows_of_one_id_apart(spark, tool, ids):
    rng = random.Random(12)
    passage, clean = prose(rng, 60), prose(rng, 400)
    texts = [clean, prose(rng, 90) + passage + passage, prose(rng, 30) + passage, clean[:20], clean]
    rows = documents(spark, texts, ids)
    whole = len(clean.encode())
    found = sorted((r.n_bytes, r.n_removed) for r in tool.repeated_spans(rows).collect())
    # equal rows of one id are one document
    assert [x for n, x in found if n == whole] == ([0, whole] if ids[0] != ids[4] else [0, 0])
    assert sum(x > 0 for n, x in found if n < whole) == 2 and found[0][1] == 0
    if tool is suffix_dedup:
        kept = [r.text for r in suffix_dedup.remove_repeats(rows).collect()]
        assert kept.count(clean) == 2 and kept.count(clean[:20]) == 1


def test_suffix_dedup_cuts_whole_characters(spark):
    text = "é" * 300
    out = suffix_dedup.remove_repeats(documents(spark, ["x" + text, text], [1, 2])).orderBy("doc_id").collect()
    assert out[0].text.startswith("x") and set(out[0].text[1:]) <= {"é"} and out[0].n_chars == len(out[0].text)
    assert out[1].text == "" and out[1].lang == "en" and out[1].score == 0.5


def test_suffix_order():
    rng = np.random.default_rng(5)
    for _ in range(400):
        s = rng.integers(1, rng.integers(2, 5), rng.integers(0, 70))
        assert suffix_dedup.suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        for reach in (1, 3, 9):
            got = suffix_dedup.suffix_order(s, reach).tolist()
            keys = [s[i: i + reach].tolist() for i in got]
            assert sorted(got) == list(range(len(s))) and keys == sorted(keys)


# -- 2 ------------------------------------------------------------------------

def test_chat_round_trip(spark):
    texts = ["hi", "</s>[INST] ok [/INST]", None, "␛1␛", "<<SYS>><</SYS>> [/TURN][ROLE] ", "", "<s><s>", "[ANSWER]"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(zip(["system", "user", "assistant"] + ["user", "assistant"] * 3, texts))]
    rows += [(2, 0, "assistant", "first"), (3, 1, "tool [ROLE]", "x"), (3, 0, None, "y"), (None, 0, "user", "z"), (4, 0, "user", "q"), (4, 1, "assistant", "a"), (4, 1, "assistant", "a")]
    given = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, valid string")
    out = {r.conv_id: r for r in chat.format_conversations(given).collect()}
    assert set(out) == {1, 2, 3, 4, None}
    for conv, r in out.items():
        turns = sorted(((t, ro or "", x or "") for c, t, ro, x in rows if c == conv))
        assert chat.parse(r.formatted, chat.INSTRUCTIONS) == [(ro, x) for _, ro, x in turns]
        assert "".join(s.text for s in r.segments) == r.formatted
        learned = "".join(chat.unescape(s.text) for s in r.segments if s.loss)
        assert learned == "".join(x for _, ro, x in turns if ro == "assistant")
    assert [out[c].valid for c in (1, 2, 3, 4, None)] == [False, False, False, False, False]
    ok = spark.createDataFrame([(9, 0, "system", "s"), (9, 1, "user", "u"), (9, 2, "assistant", "a")], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_conversations(ok).first().valid
    assert chat.format_conversations(ok.limit(0)).count() == 0


def test_chat_long_turn(spark):
    long = "[INST] ␛ words and </s> " * 60_000
    given = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", long)], "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_conversations(given).first()
    assert out.valid and chat.parse(out.formatted, chat.INSTRUCTIONS) == [("user", "q"), ("assistant", long)]
    assert "".join(chat.unescape(s.text) for s in out.segments if s.loss) == long


# -- 3 ------------------------------------------------------------------------

def shingles(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    low = {i: i for i, _ in sets}
    links = [(a, b) for a, x in sets for b, y in sets if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    while True:
        old = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if old == low:
            return low


@pytest.mark.parametrize("hot_from,everything_hot", [(16, False), (2, False), (2, True)])
def test_jaccard_join_is_brute_force(spark, monkeypatch, hot_from, everything_hot):
    monkeypatch.setattr(jaccard_join, "HOT_FROM", hot_from)
    if everything_hot:  # bit maps that are full tell nothing apart
        monkeypatch.setattr(jaccard_join, "_bits", lambda frequent: np.full((jaccard_join.LEVELS, 1 << 20), -1, np.int64).view(np.uint64))
    rng = random.Random(11)
    texts = corpus(7)
    base = prose(rng, 60)
    for k in range(20):  # a chain of small changes, so components are wider than links
        words = base.split(" ")
        words[rng.randrange(60)] = f"w{k}"
        base = " ".join(words)
        texts.append(base)
    rows = list(enumerate(texts))
    found = {r.doc_id: r for r in jaccard_join.classes(documents(spark, texts)).collect()}
    want = linked(rows)
    assert {i: r.component_id for i, r in found.items()} == want
    assert {i: r.n_shingles for i, r in found.items()} == {i: len(shingles(t)) for i, t in rows}


def test_jaccard_join_odd_rows(spark):
    t = "a b c d e f g h"
    got = jaccard_join.classes(documents(spark, [t, t, None, "", t, "A  b"], [7, 3, 1, 2, None, 9]))
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == {(7, 4, 3), (3, 4, 3), (1, 0, 1), (2, 0, 2), (None, 4, None), (9, 1, 9)}
    assert jaccard_join.classes(documents(spark, [t]).limit(0)).count() == 0
    clash = documents(spark, [t, t, "x"], [7, 3, 9]).selectExpr("*", "1 as other", "2 as _", "3 as a", "4 as component_id")
    kept = jaccard_join.keep_one(clash)
    assert kept.columns == clash.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 9] and kept.columns[:2] == ["doc_id", "text"]


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out[:n]


@pytest.mark.parametrize("size", [1024, 4096])
def test_jaccard_join_tells_structured_words_apart(spark, size):
    """Complementary Thue-Morse words collide under any polynomial modulo a power of two."""
    t = thue_morse(size)
    u = t.translate(str.maketrans("ab", "ba"))
    texts = [f"{t} one two three four", f"{u} one two three four", f"{t} x y z w {u} x y z w"]
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.classes(documents(spark, texts)).collect()} == {(0, 1, 0), (1, 1, 1), (2, 6, 2)}


def test_jaccard_join_rests_on_no_hash(spark, monkeypatch):
    """All words hashed to a few values: candidates abound, links stay those of the words."""
    class Colliding(jaccard_join.WordHash):
        def __call__(self, starts, ends):
            return super().__call__(starts, ends) % np.uint64(3)

    texts = [t for t in corpus(9, 12) if t is None or len(t) < 900]
    monkeypatch.setattr(jaccard_join, "WordHash", Colliding)
    found = {r.doc_id: r.component_id for r in jaccard_join.classes(documents(spark, texts)).collect()}
    want = linked(list(enumerate(texts)))
    assert all(want[i] == want[found[i]] for i in found)  # nothing is linked that shouldn't be


def test_overlaps_are_sets():
    import pyarrow as pa

    rng = random.Random(31)
    left = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    right = [" ".join(rng.choice("abC") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    got = jaccard_join.overlaps(pa.array(left), pa.array(right), 5)
    assert list(zip(*map(list, got))) == [(len(shingles(x)), len(shingles(y)), len(shingles(x) & shingles(y))) for x, y in zip(left, right)]


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (3, 4), (4, 10), (5, 5)], "a bigint, b bigint")
    assert {tuple(r) for r in components(links).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (10, 1), (8, 8), (9, 8)}


# -- 4 ------------------------------------------------------------------------

def test_warc_round_trip(spark):
    big, other = "<p>é" + "x" * 1000, "y" * 2000
    rows = [(1, "http://a/ b", big, 0), (2, None, big, 0), (3, "u", "small", 0), (4, "u", "small", 0), (5, "u", None, 0), (6, "u", other, 0), (None, "u", big, 0), (9, "é\r\n", big, 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    written = warc.write_pages(pages, archive_bytes=1500)
    assert all(gzip.decompress(r.content).startswith(b"WARC/1.1\r\n") for r in written.collect())
    normal = warc.normalise(written)
    got = {r.page_id: r for r in warc.read_records(normal).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("revisit", 9), 2: ("revisit", 9), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 9), 9: ("response", None)}
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    index = warc.sidecar(normal).collect()
    content = {r.archive: r.content for r in normal.collect()}
    for i in index:  # each record is a gzip member of its own
        assert zlib.decompress(content[i.archive][i.offset: i.offset + i.length], 31).startswith(b"WARC/1.1")
    assert warc.read_records(warc.normalise(warc.write_pages(pages.limit(0)))).count() == 0


def test_warc_long_payloads_and_other_columns(spark):
    """Columns named as the operator's own are ignored; of two equal rows with the largest id both are responses."""
    long = "<p>" + "long é " * 400_000
    rows = [(1, "u", long, "size", True), (2, "u", long, "x", False), (2, "u", long, "y", None), (3, "u", "short", None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, refers_to string, revisit boolean")
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_records(warc.normalise(warc.write_pages(pages))).collect())
    size = len(long.encode())
    assert got == [(1, "revisit", 2, size), (2, "response", None, size), (2, "response", None, size), (3, "response", None, 5)]


def test_warc_files(spark, tmp_path):
    """Real files: one gzip stream over all records, read, normalised, and records found by the sidecar's offsets."""
    parts = [warc.record(k, f"http://a/{k}", b"<p>%d" % k * 500, hashlib.sha1(b"<p>%d" % k * 500).hexdigest()) for k in range(20)]
    for name, content in (("one.warc.gz", gzip.compress(b"".join(parts[:12]))), ("two.warc.gz", b"".join(map(gzip.compress, parts[12:])))):
        (tmp_path / name).write_bytes(content)
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.warc.gz")).selectExpr("path as archive", "content")
    normal = warc.normalise(files)
    assert sorted(r.page_id for r in warc.read_records(normal).collect()) == list(range(20))
    for r in normal.collect():
        out = tmp_path / (r.archive.rsplit("/", 1)[1] + ".new")
        out.write_bytes(r.content)
        assert gzip.decompress(out.read_bytes()) == b"".join(parts[:12] if "one" in r.archive else parts[12:])
        with out.open("rb") as f:
            for i in warc.sidecar(normal.where(f"archive = '{r.archive}'")).collect():
                f.seek(i.offset)
                assert zlib.decompress(f.read(i.length), 31) == parts[int(i.record_id[10:-1])]


def test_warc_long_record_takes_linear_time():
    import time

    took = []
    for mb in (8, 64):
        content = gzip.compress(warc.record(1, "u", bytes(mb << 20), "d"), 1)
        began = time.process_time()
        assert len(next(iter(warc.records(content)))[1]) > mb << 20
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.5


def test_warc_inflates_any_layout():
    parts = [warc.record(k, "u", bytes([65 + k]) * (k * 70_000), "d") for k in range(4)]
    one, many = gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts))
    for content in (one, many, gzip.compress(parts[0] + parts[1]) + gzip.compress(parts[2] + parts[3])):
        assert [r for _, r in warc.records(content)] == parts
    with pytest.raises(ValueError):
        list(warc.records(gzip.compress(parts[3][:-10])))
    with pytest.raises(ValueError):
        list(warc.records(gzip.compress(b"no record\r\n\r\n")))
    assert list(warc.records(gzip.compress(b""))) == [] and io.BytesIO


# -- 5 ------------------------------------------------------------------------

def item_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination_is_brute_force(spark, block):
    rng = random.Random(4)
    texts = corpus(3)
    items = [(1, " ".join(texts[9].split()[2:20])), (2, "Two, WORDS"), (10, texts[12]), (3, None), (4, "..."), (None, texts[13]), (5, prose(rng, 30)), (1, "one")]
    found = decontamination.find_overlaps(documents(spark, texts), spark.createDataFrame(items, "item_id bigint, text string"), max_bytes=block)
    windows = {}
    for i, t in items:
        w = item_words(t)
        k = min(10, len(w))
        if k and i is not None:
            for a in range(len(w) - k + 1):
                windows.setdefault(tuple(w[a: a + k]), set()).add(str(i))
    for r in found.collect():
        w = item_words(texts[r.doc_id])
        hit, ids = set(), set()
        for a in range(len(w)):
            for k in range(1, 11):
                if (x := windows.get(tuple(w[a: a + k]))) and len(w[a: a + k]) == k:
                    hit |= set(range(a, a + k))
                    ids |= x
        assert (r.n_words, sum(b - a for a, b in r.runs), r["items"]) == (len(w), len(hit), sorted(ids))
        raw = (texts[r.doc_id] or "").encode()
        assert item_words(" ".join(raw[s.start: s.end].decode() for s in r.spans)) == [w[i] for i in sorted(hit)]
    docs = documents(spark, texts).selectExpr("*", "1 as row", "2 as _", "3 as d", "4 as items")
    kept = decontamination.decontaminate(docs, spark.createDataFrame(items[:1], "item_id bigint, text string"), max_bytes=block)
    assert kept.columns == docs.columns and 9 not in {r.doc_id for r in kept.collect()}
    assert decontamination.find_overlaps(docs.limit(0), spark.createDataFrame(items, "item_id bigint, text string").limit(0)).count() == 0


# -- 6 ------------------------------------------------------------------------

def test_html_main_text(spark):
    page = ("<html><head><title>t</title><style>p{}</style></head><body class='sidebar'><header>Site</header><nav><a>menu</a></nav><div class='ad'>buy</div>"
            "<article class=post><h1>Head &amp; <i>line</i></h1><p>one\n two<br>three<p>fo<b>ur</b> 1 < 2<ul><li>x<li>y</ul><div class='comments'><p>me too</div>"
            "<script>var t='</p>';</script><form>mail</form></article><aside>side</aside><footer>&copy;</footer></body></html>")
    plain = "<div id=main-column><p>long text of the page itself<p>more of it</div><div class='x y'><p>short</div>"
    pages = spark.createDataFrame([(1, "http://h.org/a", page, 1), (2, "odd", None, 1), (3, None, plain, 1), (4, "http://h.org/b", "", 1), (5, "u", "<p>a<!-- b", 1)], "page_id bigint, url string, html string, n_chars int")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == {1: "Head & line\n\none two three\n\nfour 1 < 2\n\nx\n\ny", 2: "", 3: "long text of the page itself\n\nmore of it\n\nshort", 4: "", 5: "a"}
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_template(spark):
    rng = random.Random(2)
    rows = []
    for k in range(12):
        body = "".join(f"<section><h2>{prose(rng, 3)}</h2><p>{prose(rng, 12)}</p><pre>{prose(rng, 5)}</pre></section>" for _ in range(rng.randint(2, 6)))
        rows.append((k, f"https://Site.example/{k}", f"<div><span>Our shop</span></div><div class=c><h1>{prose(rng, 4)}</h1><p>Filed under news</p>{body}</div><div><p>All rights kept by the shop and its many friends everywhere</p></div>"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    tokens = html_text.template_tokens(pages)
    assert tokens.where("is_text and least = 1 and most = 1 and n_pages = 12").count() == 3
    assert tokens.where("parent_class <> 0").count() > 0
    for r in html_text.extract(pages).collect():
        want = [" ".join(re.sub("<[^>]*>", "", x).split()) for x in re.findall(r"<(?:h1|h2|pre|p)>.*?</(?:h1|h2|pre|p)>", rows[r.page_id][2])]
        assert r.text == "\n\n".join(x for x in want if not x.startswith(("Filed", "All rights")))
        assert r.n_chars == len(r.text)


def test_html_keeps_the_article_whole(spark):
    """Names that only hold a word of the lists, formulas, and a sentence on every page stay in an article."""
    rows, want = [], {}
    for k in range(12):
        body = (f"<h1>Title {k}</h1><section class='related-work'><p>Others {k}</p></section><p class=legal>Law {k}</p><figure class='side'>Figure {k}</figure>"
                f"<p>See <math><mi>x{k}</mi></math> here</p><p>Thanks for reading this.</p>")
        gone = f"<div class='comment-list'><p>me too {k}</p></div><div class='ad'>buy {k}</div><nav>menu {k}</nav><div class='cookie-banner'>yes {k}</div>"
        rows.append((k, "http://h.org/x", f"<div class='related posts'>More {k}</div><article>{body}{gone}</article><div class=legal>rights {k}</div>"))
        want[k] = f"Title {k}\n\nOthers {k}\n\nLaw {k}\n\nFigure {k}\n\nSee x{k} here\n\nThanks for reading this."
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == want


@pytest.mark.parametrize("around", ["article", "main"])
@pytest.mark.parametrize("name", ["user-comments", "comments-thread", "disqus_thread", "promo-box", "top-banner", "cookie-consent-popup", "related-posts"])
def test_html_names_inside_an_article(around, name):
    page = f"<{around}><p>Text</p><section class='related-work'><p>Earlier work</p></section><div class='{name}'><p>not of it</p></div></{around}>"
    assert html_text._main_text(page, frozenset()) == "Text\n\nEarlier work"


def plain_classes(rows):
    """{(host, vector): tokens} of the texts and paths of pages, vectors written out."""
    vectors, pages = {}, {}
    for page_id, url, page in rows:
        found = html_text.blocks(page)
        content = tuple((path, text) for path, text, junk, _ in found if not junk)
        if content in pages.setdefault(url, {}):
            continue
        pages[url][content] = page_id
        counts = Counter()
        for path, _, _, _ in found:
            counts[("path", path)] += 1
        inner = {("path", path[:d]) for path, _, _, _ in found for d in range(1, len(path))}
        for t in inner - set(counts):
            counts[t] = 1
        before = Counter()
        for path, text in content:
            counts[("text", path, text, before[path, text])] = 1
            before[path, text] += 1
        for t, n in counts.items():
            vectors.setdefault((url, t), []).append((page_id, n))
    out = {}
    for (url, t), v in vectors.items():
        if len(v) >= max(html_text.MIN_SUPPORT, html_text.MIN_SHARE * len(pages[url])):
            out.setdefault((url, tuple(v)), []).append(t)
    return sorted(len(c) for c in out.values() if len(c) >= html_text.MIN_TOKENS)


def test_html_classes_are_brute_force(spark):
    rng = random.Random(21)
    rows = []
    for k in range(60):
        parts = [f"<div class=a><p>Shop</p><p>Rights</p><p>Rights</p></div>" if rng.random() < 0.8 else "", f"<div><p>{rng.choice('pqr')}</p><p>{rng.randint(0, 3)}</p></div>",
                 "<ul>" + "".join(f"<li>{rng.choice('xyz')}" for _ in range(rng.randint(1, 3))) + "</ul>", "<section><b>One</b><i>two</i></section>" if rng.random() < 0.5 else ""]
        rows.append((k, f"http://h{k % 5}.org", "".join(parts)))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as host", "2 as token")
    got = html_text.template_tokens(pages).groupBy("host", "class_id").count().collect()
    assert sorted(r["count"] for r in got) == plain_classes(rows) and len(got) > 4


def test_html_template_changes_pages(spark, monkeypatch):
    """Without the template unmarked boilerplate stays; a host of three pages has one too."""
    rng = random.Random(22)
    rows = [(k, f"http://{'small' if k < 3 else 'large'}.org/{k}", f"<div class=top><p>Our shop</p><p>Since 1990</p><p>Call us</p></div><div class=text><p>{prose(rng, 30)}</p></div>") for k in range(15)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    on = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    monkeypatch.setattr(html_text, "MIN_TOKENS", 1 << 30)
    off = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert all(off[k] == f"Our shop\n\nSince 1990\n\nCall us\n\n{on[k]}" for k in range(15))


def test_html_long_page(spark):
    page = "<article>" + "".join(f"<p>{k} words" for k in range(60_000)) + "</article>"
    got = html_text.extract(spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string")).first()
    assert got.text == "\n\n".join(f"{k} words" for k in range(60_000)) and got.n_chars == len(got.text)


def test_html_template_by_share_of_pages(spark):
    """Sections in sibling containers, boilerplate on most pages or twice in a page, an error page, copies."""
    rng = random.Random(14)
    rows, want = [], {}
    copied = [prose(rng, 30), prose(rng, 9)]
    for k in range(24):
        one, two = copied if k < 12 else [prose(rng, 30), prose(rng, 9)]
        banner = "" if k == 20 else "<div class=b><p>Our shop</p><p>Our shop</p><p>All rights kept</p></div>"
        rows.append((k, f"https://site.example/{k}", f"<nav>{prose(rng, 3)}</nav>{banner}<div id=s1><p>{one}</p></div><div id=s2><p>{two}</p></div><script>{k}</script>"))
        want[k] = f"{one}\n\n{two}"
    rows.append((24, "https://site.example/e", "<div><h1>Not found</h1></div>"))
    want[24] = "Not found"
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == want


# -- 7 ------------------------------------------------------------------------

TEST_DATA = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not TEST_DATA.exists(), reason="no test data")
def test_language_held_out(spark):
    got = language.op7(spark, str(TEST_DATA)).join(spark.read.parquet(f"{TEST_DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) > 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_is_brute_force(spark):
    """Predictions against a plain loop that compresses piece by piece."""
    import zstandard

    rng = random.Random(17)
    given = {"aa": prose(rng, 400), "bb": " ".join("".join(rng.choice("nopqrs") for _ in range(4)) for _ in range(400)), "cc": "und der die das mit " * 40}
    raw = {k: language.normalised(v).encode() for k, v in given.items()}
    texts = [*(v[: rng.randrange(20, 900)] for v in given.values() for _ in range(6)), prose(rng, 3000), "der nop é", given["aa"][:60] + given["bb"][:60]]
    docs = documents(spark, texts).selectExpr("*", "1 as row", "2 as lang_pred", "3 as margin")
    tools = {k: zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for k, v in raw.items()}
    for r in language.identify(docs, raw).collect():
        text = re.sub(r"[\W\d_]+", " ", texts[r.doc_id].lower()).encode()
        sizes = {k: sum(len(t.compress(text[i: i + language.PIECE_BYTES])) for i in range(0, len(text), language.PIECE_BYTES)) for k, t in tools.items()}
        best, second = sorted(sizes.values())[:2]
        assert sizes[r.lang_pred] == best and abs(r.margin - 100 * (second - best) / best) < 1e-9 and r.rejected == (r.margin < language.MIN_MARGIN)
        assert abs(r.score - 1 / sum(2 ** ((best - x) / best * 100 / language.HALF_LIFE) for x in sizes.values())) < 1e-9
    kept = language.keep_identified(docs, raw)
    assert kept.columns == docs.columns and kept.count() <= len(texts) and language.identify(docs.limit(0), raw).count() == 0


def test_language_is_not_lost_to_copies(spark):
    """20,000 copies of one text beside five others, a language of one text, and fewer texts than the sample."""
    rng = random.Random(5)
    rows = [("fr", "le la les un une des et pour")] * 20_000 + [("fr", f"le chat numero {prose(rng, 9)}") for _ in range(5)] + [("de", f"der die das {prose(rng, 9)}") for _ in range(200)] + [("es", "el los las una")]
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string")
    learned = language.learn(docs)
    assert list(learned) == ["de", "fr", "es"]
    assert learned["fr"].count(b"le la les") == 1 and learned["fr"].count(b"le chat") == 5 and learned["de"].count(b"der die das") == language.SAMPLE_DOCS


def test_language_odd_rows(spark):
    docs = documents(spark, ["the and of that with", None, "", "12 !?", "der die und das mit"])
    found = {r.doc_id: r for r in language.identify(docs, {"en": b"the and of that with which", "de": b"der die und das mit einem"}).collect()}
    assert [found[i].lang_pred for i in range(5)] == ["en", "und", "und", "und", "de"]
    assert found[1].rejected and found[1].score == 0.0 and not found[4].rejected
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}
    assert language.learn(docs.where("text is null")) == {}
    assert language.keep_identified(docs, {"en": b"the"}).columns == docs.columns


# -- 8 ------------------------------------------------------------------------

def all_segmentations(tool, chunk):
    out = []

    def go(a, score, ids):
        if a == len(chunk):
            out.append((score, ids))
        for b in range(a + 1, len(chunk) + 1):
            if found := tool.pieces.get(chunk[a:b]):
                go(b, score + found[1], (*ids, found[0]))
            elif b == a + 1:
                go(b, score + tool.unknown, (*ids, *(tool.byte_ids[x] for x in chunk[a].encode())))
    go(0, 0.0, ())
    return sorted(out, key=lambda x: -x[0])


def test_segmentation_is_brute_force():
    tool = segmentation.Segmenter(segmentation.load_pieces(segmentation.default_model()))
    rng = random.Random(6)
    chunks = sorted({" ", "  ab", " é▁x", " the", *(" " + "".join(rng.choice("aethion\né漢") for _ in range(rng.randint(0, 10))) for _ in range(80)), " " + "ab" * 50})
    tool.learn(chunks)
    for c in chunks[:-1] if len(chunks[-1]) > 20 else [c for c in chunks if len(c) < 20]:
        want, got, k = all_segmentations(tool, c), tool.nbest(c, 4), tool.place[c]
        assert [s for s, _ in got] == [s for s, _ in want[:4]] and all(x in want for x in got)
        assert tool.score[k] == want[0][0] and tool.gap[k] == (want[0][0] - want[1][0] if len(want) > 1 else np.inf)
    text = "a the\n x"
    (_, chunks, places, ids), = tool.split([text])
    best = tool.text_nbest(chunks, places, 5)
    assert [s for s, _ in best] == [s for s, _ in all_segmentations(tool, " " + text)[:5]]
    assert tool.decode(ids.tolist()) == text


def test_segmentation_rows(spark):
    texts = ["", None, " two  spaces ", "▁ literal\n\ttab", "é漢\U0001f600\0", "plain words here", "plain words here", "x" * 300]
    out = {r.doc_id: r for r in segmentation.encode(documents(spark, texts)).collect()}
    assert out[1].n_tokens is None and out[0].n_tokens == 0 and out[0].scores == [0.0]
    assert all(out[i].round_trip for i in out if i != 1) and out[5].tokens == out[6].tokens
    back = {r.doc_id: r.text for r in segmentation.decode(segmentation.encode(documents(spark, texts))).collect()}
    assert back == dict(enumerate(texts))


def test_segmentation_empty_long_and_other_columns(spark):
    texts = ["plain words", "long text, é漢 " * 20_000]
    given = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int, row string")
    encoded = segmentation.encode(given)
    assert {r.doc_id: r.text for r in segmentation.decode(encoded).collect()} == dict(enumerate(texts))
    assert all(r.round_trip and r.n_tokens == len(r.tokens) > 1 for r in encoded.collect())
    assert segmentation.encode(given.limit(0)).count() == 0


def test_segmentation_gives_all_n(spark):
    tool = segmentation.Segmenter(segmentation.load_pieces(segmentation.default_model()))
    texts = ["a the\n x", "é漢 on it", "", "x", None, "ab ab ab"]
    rows = {r.doc_id: r for r in segmentation.encode(documents(spark, texts), n=5).collect()}
    assert rows[4].others is None and rows[2].others == []
    for k, text in enumerate(texts):
        if text:
            got = segmentation.segmentations(rows[k].tokens, rows[k].others)
            want = all_segmentations(tool, " " + text)
            assert rows[k].scores == [s for s, _ in want[:5]]
            assert len({tuple(x) for x in got}) == len(got) == min(5, len(want))
            assert all((s, tuple(ids)) in want for s, ids in zip(rows[k].scores, got))
            assert all(tool.decode(ids) == text for ids in got)


def test_segmentation_of_long_runs(spark):
    """A run of one character has very many segmentations of equal score."""
    import time

    tool = segmentation.Segmenter(segmentation.load_pieces(segmentation.default_model()))
    short = " " + "x" * 14
    assert [s for s, _ in tool.nbest(short, 4)] == pytest.approx([s for s, _ in all_segmentations(tool, short)[:4]])
    began = time.process_time()
    found = tool.nbest(" " + "x" * 20_000, 4)
    assert time.process_time() - began < 5 and len(found) == 4 and len({ids for _, ids in found}) == 4
    assert all(tool.decode(list(ids)) == "x" * 20_000 for _, ids in found)
    assert segmentation.encode(documents(spark, ["a"]).limit(0)).count() == 0


def test_segmentation_forgets_rare_chunks(monkeypatch):
    monkeypatch.setattr(segmentation, "KEEP_CHUNKS", 40)
    tool, plain = (segmentation.Segmenter(segmentation.load_pieces(segmentation.default_model())) for _ in range(2))
    rng = random.Random(3)
    for _ in range(12):
        texts = [prose(rng, 9) + " the of and the", "the of and"]
        monkeypatch.setattr(segmentation, "KEEP_CHUNKS", 40)
        got = [(k, ids.tolist()) for k, _, _, ids in tool.split(texts)]
        monkeypatch.setattr(segmentation, "KEEP_CHUNKS", 10_000)
        assert got == [(k, ids.tolist()) for k, _, _, ids in plain.split(texts)]


@pytest.mark.skipif(not TEST_DATA.exists(), reason="no test data")
def test_segmentation_query_has_tokens(spark):
    assert {"tokens", "others"} <= set(segmentation.op8(spark, str(TEST_DATA)).columns)


# -- 9 ------------------------------------------------------------------------

def base_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i: i + 5]) for i in range(len(w) - 4)]
    twice = {x for x, n in Counter(windows).items() if n > 1}
    marked = {i + k for i, x in enumerate(windows) if x in twice for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked)


def test_quality_counts(spark):
    texts = [*corpus(5), "a b c d e a b c d e", "x x x x x x x", "\u0085one two # |\x0b\f", "one two\n\none two\n \n one two", "l\r\nl\r\nl"]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.counts(documents(spark, texts)).collect()}
    assert got == {i: base_counts(t) for i, t in enumerate(texts)}
    plan = quality.votes(quality.counts(documents(spark, texts)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_lines_of_f_and_form_feeds(spark):
    texts = ["f\nf\nf f", "\x0c\n\x0c\nend", "f\x0c\nf\x0c\n\x0b\x0c\r"]
    rows = quality.counts(documents(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dup_lines) for r in rows] == [(3, 1), (1, 0), (2, 1)]
    assert [r.n_dup_lines for r in rows] == [base_counts(t)[3] for t in texts]


def test_quality_estimation():
    rng = random.Random(8)
    rows = []
    for _ in range(4000):
        good = rng.random() < 0.7
        hit = [0.01, 0.20, 0.79] if good else [0.4, 0.35, 0.25]
        rows.append((good, tuple(rng.choices((-1, 0, 1), hit)[0] for _ in quality.RULES)))
    share, shares = quality.estimate(sorted(Counter(v for _, v in rows).items()))
    assert abs(share - 0.7) < 0.05
    right = sum((quality.posterior(v, share, shares) >= 0.5) == good for good, v in rows)
    assert right > 0.95 * len(rows)
    assert quality.estimate([])[0] == quality.START_GOOD


def test_quality_departs_from_all_must_pass():
    """A rule that rejects every tenth of the documents that all others speak for is outvoted."""
    n = len(quality.RULES)
    odd = tuple(-1 if r == 3 else 1 for r in range(n))
    junk = tuple(-1 if r in (1, 3, 5) else 1 if r % 2 else 0 for r in range(n))
    share, shares = quality.estimate([((1,) * n, 700), (odd, 90), (junk, 210)])
    assert quality.posterior(odd, share, shares) >= 0.5 > quality.posterior(junk, share, shares)


def test_quality_rules_stand_alone():
    """No rule's condition holds that of another, and most can speak for a document."""
    counts = {name: set(re.findall(r"n_[a-z_]+|word_chars", " ".join(x for x in r if x))) - {"n_words", "word_chars", "n_lines"} for name, r in quality.RULES.items()}
    assert all(len(c) <= 1 for c in counts.values()) and len({frozenset(c) for c in counts.values() if c}) == sum(bool(c) for c in counts.values())
    assert sum(r[1] is not None for r in quality.RULES.values()) >= 3


@pytest.mark.skipif(not TEST_DATA.exists(), reason="no test data")
def test_quality_agrees_with_labels(spark):
    """Thresholds were set on the labels of the table ten times as large, not on these rows."""
    kept = quality.op9(spark, str(TEST_DATA)).where("doc_id % 2 = 1").join(spark.read.parquet(f"{TEST_DATA}/labels.parquet").dropDuplicates(["doc_id"]), "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in kept if r.quality == 1], [r.kept for r in kept if r.quality == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.1 * len(bad) and len(bad) > 5
    judged = quality.judge(spark.read.parquet(f"{TEST_DATA}/documents.parquet"))
    rows = {(r.kept, r.all_pass): r.n for r in quality.departures(judged).collect()}
    assert rows[True, False] > 0


def test_quality_long_and_other_columns(spark):
    """A text of 300,000 words is counted whole; columns named as the operator's own are ignored; letters are counted one by one."""
    rng = random.Random(3)
    long = " ".join(f"Wörd{i}ÄÖ" for i in range(300_000))
    texts = [long, "ABC déF 12 x.", prose(rng, 50)]
    given = spark.createDataFrame([(i, t, "x", -1) for i, t in enumerate(texts)], "doc_id bigint, text string, words string, n_words int")
    got = {r.doc_id: r for r in quality.judge(given).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n_letters, got[i].n_upper) == (len(t.split()), sum(c.isalpha() for c in t), sum(c.isupper() for c in t))
    assert got[0].n_repeat_words == 0


def test_quality_empty(spark):
    assert quality.judge(documents(spark, ["a"]).limit(0)).count() == 0


# -- 10 -----------------------------------------------------------------------

def chunk_spans(rows):
    """Chunk by chunk, with the plain rolling hash."""
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        h, at, ends = 0, 0, []
        limit = (1 << 32) // (chunk_dedup.MEAN_CHUNK - chunk_dedup.MIN_CHUNK)
        for k, b in enumerate(raw):
            h = ((h << 1) + int(chunk_dedup._GEAR[b])) & 0xFFFFFFFF
            if k + 1 - at > chunk_dedup.MAX_CHUNK:
                at += chunk_dedup.MAX_CHUNK
                ends.append(at)
            if k >= 31 and h < limit and k + 1 - at >= chunk_dedup.MIN_CHUNK:
                at = k + 1
                ends.append(at)
        if at < len(raw):
            ends.append(len(raw))
        gone = bytearray(len(raw))
        for a, b in zip([0, *ends], ends):
            if first.setdefault(raw[a:b], (i, a)) != (i, a):
                gone[a:b] = b"\1" * (b - a)
        out[i] = [m.span() for m in re.finditer(b"\1+", bytes(gone)) if m.end() - m.start() >= chunk_dedup.MIN_RUN]
    return out


def test_chunk_dedup_is_brute_force(spark):
    texts = corpus(9)
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in chunk_dedup.repeated_spans(documents(spark, texts)).collect()}
    assert got == chunk_spans(list(enumerate(texts)))
    assert got[len(texts) - 2] == [] or got[len(texts) - 3]
    assert chunk_dedup.repeated_spans(documents(spark, texts).limit(0)).count() == 0


def test_chunk_dedup_reads_texts_once_for_chunks(spark):
    """Of the kernels only the one that cuts spans out is left in the result's plan; a long text and
    columns named as the operator's own change nothing."""
    long = prose(random.Random(5), 60_000)
    given = spark.createDataFrame([(0, long, 1, "x"), (1, "new " * 9 + long, 2, "y"), (2, "alone", None, None)], "doc_id bigint, text string, h int, runs string")
    found = chunk_dedup.repeated_spans(given)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {r.doc_id: r for r in found.collect()}
    assert set(got) == {0, 1, 2} and got[2].n_removed == 0
    assert got[1].n_removed > 0.99 * len(long.encode()) and got[1].n_bytes == len(long.encode()) + 36


def test_chunk_dedup_removes_short_repeats(spark):
    rng = random.Random(13)
    short, one, two = "That it.", prose(rng, 90), prose(rng, 90)
    texts = [short, one, short, two + one[-15:], short]
    got = {r.doc_id: r.n_removed for r in chunk_dedup.repeated_spans(documents(spark, texts)).collect()}
    assert got[0] == 0 and got[2] == got[4] == len(short)
    first, want = set(), {}
    for i, t in enumerate(texts):  # every chunk but the first of its bytes
        raw = np.frombuffer(t.encode(), np.uint8)
        ends = chunk_dedup.cuts(chunk_dedup.gear_hash(raw), np.array([0, len(raw)]))[0].tolist()
        parts = [raw[a:b].tobytes() for a, b in zip([0, *ends], ends)]
        want[i] = sum(len(x) for x in parts if x in first or first.add(x))
    assert got == want


def test_chunks_resist_insertion():
    text = prose(random.Random(1), 400).encode()
    parts = lambda raw: {raw[a:b] for e in chunk_dedup.cuts(chunk_dedup.gear_hash(np.frombuffer(raw, np.uint8)), np.array([0, len(raw)])) for a, b in zip([0, *e.tolist()], e.tolist())}
    moved = parts(text[:500] + b"inserted" + text[500:])
    assert len(parts(text) - moved) <= 4


# -- 11 -----------------------------------------------------------------------

def best_vectors(rows, asks, k=5):
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in {(i, tuple(v)) for i, v in good if asks(i)}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))
        out |= {(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("block,left", [(2048, 64), (16, 2), (5, 1)])
def test_top_k_is_brute_force(spark, monkeypatch, block, left):
    """Random, equal, huge and missing components, ties, several lengths, few rows."""
    monkeypatch.setattr(topk_search, "_LEFT", left)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.2, (160, 8)))]
    rows += [(i, [0.25, -0.5, 0.0, 0.1, 0.1, 0.1, 0.1, 0.1]) for i in range(160, 200)]  # one vector, many ids
    rows += [(200, None), (None, [0.1] * 8), (250, [0.1, None]), (300, [0.1, float("nan")]), (350, [float("inf")]), (400, []), (401, []), (450, [1.5, 2.0]), (451, [2e4, -3e6]), (452, [1.0, 1.0]), (500, [0.5] * 3)]
    vectors = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<double>, score int, g int")
    got = topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), block_rows=block, query_rows=3)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {tuple(r) for r in got.collect()} == best_vectors(rows, lambda i: i % 50 == 0)
    assert topk_search.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_top_k_repeated_rows(spark):
    """Repeated rows count each as candidates, and once as queries; two vectors under one id ask apart."""
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [0.0, -1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [0.5, -1.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = Counter((r.query_id, r.vec_id, r.score) for r in topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), 3).collect())
    u = 256 * 256
    assert got == {(50, 7, u): 2, (50, 8, u // 2): 1, (100, 7, u): 2, (100, 50, 0): 3, (100, 8, u): 1}


def test_top_k_of_large_components_is_exact(spark):
    rows = [(0, [1e5, 3e5, 7e4]), (1, [2e5 + 1 / 256, 1e5, 9e4]), (2, [2e5, 1e5, 9e4]), (3, [-1e5, 5e4, 1e3])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk_search.top_k(vectors, vectors.where("vec_id = 0")).collect()
    assert {tuple(r) for r in got} == best_vectors(rows, lambda i: i == 0)


def test_top_k_stops_early():
    """What the lists' ends show is enough: a bound of the first entries leaves few rows."""
    rng = np.random.default_rng(8)
    v = np.floor(256 * rng.normal(0, 0.1, (512, 4)))
    v[7] = [400, 400, -400, 0]
    lists = np.argsort(v, axis=0, kind="stable").T.astype(np.uint16)
    low, high = topk_search._bounds(np.array([[3.0, 2.0, -1.0, 0.0]]), v, lists, 64)
    exact = np.array([[3.0, 2.0, -1.0, 0.0]]) @ v.T
    assert (low <= exact).all() and (exact <= high).all() and (high >= low.max()).sum() < 64 and (low < high).any()


def test_top_k_gathers_no_copies_of_queries(spark):
    """The copies of the queries, which Spark's guess of a size doesn't count, go by a shuffle: a broadcast
    would hold all of them in the driver. Nor does adaptive execution turn the join into one."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.2, (300, 8)))]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    best = topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), block_rows=16)
    assert {tuple(r) for r in best.collect()} == best_vectors(rows, lambda i: i % 50 == 0)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


# -- 12 -----------------------------------------------------------------------

def spelling_rows(rows, every=97):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), None if form[w] is None else counts[form[w]])
    return out


@pytest.mark.parametrize("block", [256, 3])
def test_spelling_variants_are_brute_force(spark, block):
    """Words over few letters, so that many are near, also in groups of many tiles; long words; odd rows."""
    rng = random.Random(41)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 7))) for _ in range(60)] + ["q" * 3000, "q" * 2999, "q" * 1500 + "r" + "q" * 1499, "STRASSE", "stra\u00dfe", "\u00c0bcdef", "\u00e0bcdef"]
    texts = [None, "", "12 !?"] + [" ".join(rng.choice(words) if rng.random() < 0.9 else w for w in rng.sample(words, 40)) for _ in range(30)]
    docs = documents(spark, texts, [None, None, 3, *range(30)]).selectExpr("*", "1 as word", "2 as n", "3 as form")
    counts = spelling_rows(list(zip([None, None, 3, *range(30)], texts)))
    got = spelling.variants(spelling.word_counts(docs), block_words=block)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = {r.word: tuple(r)[1:] for r in got.collect()}
    want = plain_variants(counts)
    assert found == want and len(want) > 40
    assert spelling.variants(spelling.word_counts(docs.limit(0))).count() == 0


def test_spelling_chains(spark):
    rows = [("abcde", 100), ("abcdf", 40), ("abcgf", 20), ("abhgf", 10), ("xbhgf", 9), ("zzzzz", 3)]
    words = spark.createDataFrame(rows, "word string, n bigint")
    found = {r.word: tuple(r)[1:] for r in spelling.variants(words).collect()}
    assert found == plain_variants(dict(rows)) and found["abhgf"][:2] == ("abcgf", "abcde") and found["xbhgf"][0] is None


# -- 13 -----------------------------------------------------------------------

def plain_collocations(rows, least, top):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i: i + k])] += 1
    found = {(lang, p): a for (lang, p), a in counts.items() if len(p) > 1 and a >= least}
    out = {}
    for (lang, p), a in found.items():
        inside = any(other == lang and len(q) > len(p) and b >= a and any(q[i: i + len(p)] == p for i in range(len(q))) for (other, q), b in found.items())
        if not inside:
            score, _, l, r = min((1000 * a * total[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, rank, p.decode(), -a, l, r, total[lang], -s) for lang, x in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1)}


@pytest.mark.parametrize("least,cells,slice_bytes", [(4, 1 << 20, 1 << 22), (4, 1 << 18, 200), (2, 1 << 16, 1 << 22), (300, collocations.CELLS, 1 << 22)])
def test_collocations_are_brute_force(spark, monkeypatch, least, cells, slice_bytes):
    """Also with small slices, with counts past one byte, and in a table so small that all cells are frequent."""
    monkeypatch.setattr(collocations.text_slices, "__defaults__", (slice_bytes,))
    rng = random.Random(51)
    vocabulary = ["a", "the", "A", "of", "x\u00e9", "\u00a0", "new", "york", "#1", "end\u2028"]
    texts = [None, "", " \t ", ".,;", "one"] + ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "!", " :"]) for _ in range(rng.randint(1, 120))) for _ in range(60)] + ["to be or not to be " * (20 if least < 300 else 400)] * 2
    langs = [rng.choice(["en", "de", None, "und"]) for _ in texts]
    docs = spark.createDataFrame([(lang, t, 1, 2, 3) for lang, t in zip(langs, texts)], "lang string, text string, w1 int, n int, phrase int")
    got = collocations.collocations(docs, least, 15, cells)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain_collocations(list(zip(langs, texts)), least, 15)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 2
    assert collocations.collocations(docs.limit(0), least).count() == 0


def test_collocation_scores_are_exact(spark):
    """Products past 64 bits."""
    a, n, l, r = 10**15, 9 * 10**15, 10**15 + 7, 3 * 10**15
    got = spark.createDataFrame([(a, n, l, r)], "a bigint, n bigint, l bigint, r bigint").selectExpr(
        "cast(1000 * (cast(a as decimal(19,0)) * cast(n as decimal(19,0))) as decimal(38,0)) div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0)) as score").first().score
    assert got == 1000 * a * n // (l * r)


@pytest.mark.parametrize("times", [1, 5])
def test_windows_end_where_phrases_are_rare(spark, times):
    """All triples are frequent and hardly any phrase of five words is: there are no more windows than
    phrases that count, on five times the text too."""
    rng, least = random.Random(52), 60
    texts = [" ".join(rng.choice("abcdef") for _ in range(1000)) for _ in range(25 * times)]
    counts = Counter(tuple(w[i: i + k]) for w in map(str.split, texts) for k in range(1, 6) for i in range(len(w) - k + 1))
    kept = sum(n >= least for n in counts.values())
    assert sum(n >= least for p, n in counts.items() if len(p) == 3) > 200 and len(counts) > 4 * kept
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    assert collocations.windows(docs, least).count() <= 1.05 * kept


def test_small_partitions_are_read_together(spark, tmp_path):
    """Each task gives on a table and windows of its own, so their number follows the bytes."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(8 * cores).selectExpr("'en' as lang", "'a b c' as text").repartition(8 * cores).write.parquet(str(tmp_path / "d"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        docs = spark.read.parquet(str(tmp_path / "d"))
        assert docs.rdd.getNumPartitions() > 2 * cores
        assert collocations.read_together(docs).rdd.getNumPartitions() == 2 * cores
        assert collocations.read_together(docs, 100).rdd.getNumPartitions() > 2 * cores
        got = collocations.phrase_counts(docs, 3).where("phrase = 'a b c'").first()
        assert got.f == 8 * cores
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plain = spark.createDataFrame([("en", "a")], "lang string, text string").repartition(3 * cores)
    assert collocations.read_together(plain).rdd.getNumPartitions() == 3 * cores


def test_windows_given_on_early_are_summed(spark, monkeypatch):
    """Slices of 200 bytes, and tasks that hold no more than a few windows."""
    monkeypatch.setattr(collocations._tokens, "__defaults__", (200,))
    monkeypatch.setattr(collocations, "_HELD", 20)
    rng = random.Random(53)
    rows = [(rng.choice(["en", None]), " ".join(rng.choice("abcde") + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(1, 90)))) for _ in range(50)]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), 5, 12)
    assert {tuple(r) for r in got.collect()} == plain_collocations(rows, 5, 12)
