"""HTML extraction, SentencePiece, media, chat, fingerprints and toxicity against brute force."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivener.llm import chat_format, html_extraction, iso_media, order_minhash, queries, toxicity
from scrivener.llm.sentencepiece_table import WordTable, digests, encode_decode


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


# --- HTML ---------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<div id="wrap"><div class="post post-17"><h1>Fish &amp; chips</h1><p>First <b>bold</b>&nbsp;text with a <a href="x">link</a> and enough words to count as a paragraph.
<p>Second one<br>goes on &#x2014; here, also with a good number of words.<ul><li>one<li>two</ul><form><button>Go</button></form><aside>more</aside></div>
<div class="sidebar"><p>About us and other things of no interest to anyone reading.</p></div></div>
<section id="comments"><article class="comment"><p>What a long and winding comment this is, longer than some.</p></article></section><footer>&copy; x</footer></body></html>"""
TEXT = "Fish & chips\n\nFirst bold text with a link and enough words to count as a paragraph.\n\nSecond one goes on — here, also with a good number of words.\n\none\n\ntwo"


def test_page_is_extracted_without_what_surrounds_it():
    text, path = html_extraction.extract(PAGE, [])
    assert text == TEXT and path.endswith("div.post")


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "<!-- never closed <p>x", "<div><div><div>", "</p></div>", '<a href="x', "&#xFFFFFFFF; &unknown;", "<script>x"])
def test_broken_pages_do_not_fail(html):
    text, _ = html_extraction.extract(html, ["html>body>article"])
    assert isinstance(text, str) and "never" not in text


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "<p>deep text here</p>" + "</div>" * 3000
    assert html_extraction.extract(deep, [])[0] == "deep text here"
    long = "<article>" + "<p>a paragraph of words, again</p>" * 20_000 + "</article>"
    assert html_extraction.extract(long, [])[0].count("\n\n") == 19_999


def test_article_inside_an_unclosed_notice_is_kept():
    assert html_extraction.extract("<body><div class='notice'>hi<article><p>the story itself, told.</p></article>", [])[0] == "the story itself, told."


def test_names_that_tell_of_surroundings_drop_nothing():
    page = "<body class='has-menu'><div class='wrap no-sidebar'><div class='text'><p>the story, told at length here.</p></div><div class='promo-box'>buy</div></div>"
    assert html_extraction.extract(page, [])[0] == "the story, told at length here."


def test_parts_at_the_winning_path_are_joined():
    first, second = "the first part of it, told at length. " * 6, "the second part, somewhat shorter. " * 4
    page = f"<body><div class='wrap'><div class='part-1'><p>{first}</p></div><div class='part-2'><p>{second}</p></div></div></body>"
    whole = f"{first.strip()}\n\n{second.strip()}"
    assert html_extraction.extract(page, ["html>body>div.wrap>div.part", "body>div.wrap>div.part"])[0] == whole
    loose = page.replace("part-2", "tail")
    assert html_extraction.extract(loose, ["body>div.wrap>div.part"])[0] == whole
    bare = page.replace("<div class='wrap'>", "").replace("</div></body>", "</body>")
    assert html_extraction.extract(bare, ["body>div.part"]) == (whole, "body>div.part")
    for second in ("part", "part2", "part_002"):  # without votes, too
        assert html_extraction.extract(bare.replace("part-1", "part").replace("part-2", second), [])[0] == whole


def test_headlines_in_headers_and_in_the_body_are_kept():
    story = "the story itself, told at length. " * 4
    for page in (
        f"<body><header>Site</header><article><header class='entry-header'><h1>Title</h1></header><p>{story}</p></article><footer>c</footer></body>",
        f"<body><main><header><h1>Title</h1></header><div><p>{story}</p></div></main></body>",
        f"<body><nav>menu</nav><h1>Title</h1><div class='c'><p>{story}</p></div><div class='ad'>buy</div></body>",
    ):
        assert html_extraction.extract(page, [])[0] == f"Title\n\n{story.strip()}"
    assert html_extraction.extract(f"<article><p>{story}</p><math>x = 2</math> <object>a figure</object></article>", [])[0] == f"{story.strip()}\n\nx = 2 a figure"


PIECES = ["<div>x", "<!--", '<a b="', "<a ", "<span>x", "<ul><li>x", "<a '\">", "</script ", "</b>x", '<a b="c>d', "<a b='\"><i c=\"'>", "<td>x", "<li></li>"]


@pytest.mark.parametrize("piece", PIECES)
def test_time_grows_with_the_page(piece):
    """Four times the broken markup takes some four times as long, not sixteen; text is not lost."""
    import time

    def seconds(n):
        began = time.process_time()
        text = html_extraction.extract(piece * n, ["body>div"])[0]
        assert text.count("x") == (n if "x" in piece else 0)
        return time.process_time() - began

    seconds(1000)
    assert seconds(40_000) < 8 * max(seconds(10_000), 0.05)


def test_votes_and_winners_against_brute_force(spark, sf_dir):
    """Votes by host counted outside Spark give the same winners; hosts of many paths keep those of a tenth."""
    from collections import Counter
    from urllib.parse import urlsplit

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    extra = [(1000 + i, f"http://many.example/{i}", f"<body><div class='{'ab'[i % 5 == 0]}{chr(99 + i % 20) if i % 2 else ''}'><p>{'word ' * (9 + i)}</p></div></body>") for i in range(60)]
    pages = pages.unionByName(spark.createDataFrame(extra, "page_id long, url string, html string"))
    cast = defaultdict(Counter)
    for r in pages.collect():
        best = html_extraction.Page(r["html"]).best()
        if best is not None:
            cast[(urlsplit(r["url"] or "").hostname or "").lower()][best.path()] += 1
    expected = {h: sorted((p for p, n in c.items() if n * 10 >= sum(c.values())), key=lambda p: (-c[p], -len(p), p)) for h, c in cast.items()}
    got = {r["host"]: r["paths"] for r in html_extraction.winning_paths(html_extraction.votes(pages)).collect()}
    assert got == expected and len(cast["many.example"]) > 10 and 1 <= len(got["many.example"]) < 10


def test_headline_and_lead_beside_a_named_element_are_kept():
    story = "the story itself, told at length. " * 10
    page = f"<body><div class='wrap'><h1>Headline</h1><p>And its lead.</p><div class='content'><p>{story}</p></div></div></body>"
    assert html_extraction.extract(page, [])[0] == f"Headline\n\nAnd its lead.\n\n{story.strip()}"
    assert html_extraction.extract(page, ["body>div.wrap>div.content"])[0].startswith("Headline")


def paragraphs(n, seed=0):
    """n paragraphs of made sentences, none like another."""
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(20)) + "." for _ in range(n)]


def marked_up(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_a_form_around_the_page_is_no_form():
    story = paragraphs(6)
    sign_up = "<form class='newsletter'><label>Your address</label><input><p>We write twice a week, and never more.</p></form>"
    page = f"<body><form id='aspnetForm'><input type='hidden'><nav>menu</nav><div class='content'>{marked_up(story)}{sign_up}</div></form></body>"
    assert html_extraction.extract(page, [])[0] == "\n\n".join(story)
    assert html_extraction.extract(f"<body><div class='content'>{marked_up(story)}<form>{marked_up(paragraphs(2, 1))}</form></div></body>", [])[0] == "\n\n".join(story)


def test_a_winner_that_leaves_half_is_not_taken():
    part, lead = paragraphs(6), paragraphs(5, 1)
    page = f"<body><div class='part'>{marked_up(part)}</div><div class='lead'>{marked_up(lead)}</div></body>"
    assert html_extraction.extract(page, ["body>div.part"])[0] == "\n\n".join([*part, *lead])
    # what the host's other pages leave beside their article is furniture here, too
    assert html_extraction.extract(page, ["body>div.part"], ["body>div.lead"])[0] == "\n\n".join(part)


@pytest.mark.parametrize("name", ["tags", "social-contract", "legal-text", "responses", "disclaimer", "rail", "toc", "popup", "notice", "fieldset", "label"])
def test_names_do_not_outweigh_the_text_of_a_story(name):
    head, inner, tail = paragraphs(2), paragraphs(22, 2), paragraphs(2, 3)
    wrap = (lambda x: f"<{name}>{x}</{name}>") if name in ("fieldset", "label") else (lambda x: f"<div class='{name}'>{x}</div>")
    page = f"<body><article>{marked_up(head)}{wrap(marked_up(inner))}{marked_up(tail)}</article></body>"
    assert html_extraction.extract(page, [])[0] == "\n\n".join([*head, *inner, *tail])
    small = f"<body><article>{marked_up(head)}{wrap('<p>Read more here.</p>')}{marked_up(tail)}</article></body>"
    assert html_extraction.extract(small, [])[0] == "\n\n".join([*head, *tail])
    listed = f"<body><article>{marked_up(head)}<div class='comments'>{marked_up(inner)}</div><div class='responses'>{''.join(f'<div class=r>{marked_up([t])}</div>' for t in inner)}</div></article></body>"
    assert html_extraction.extract(listed, [])[0] == "\n\n".join(head)


def test_made_pages_against_what_they_were_made_of(spark):
    """Pages of random nested containers, with furniture whose kind is known, give just the article."""
    rng = random.Random(11)
    furniture = ["<nav><a href='/'>Home</a> <a href='/b'>More</a></nav>", "<div class='ad'>Buy now</div>", "<footer>c</footer>", "<aside><p>Elsewhere</p></aside>", "<form><input><button>Go</button></form>", "<div class='cookie-notice'>We use cookies.</div>", "<script>x < 1</script>"]
    rows, expected = [], {}
    for n in range(60):
        story = paragraphs(rng.randrange(3, 12), n)
        inner, k = [], 0
        while k < len(story):
            size = rng.randrange(1, 4)
            block = marked_up(story[k : k + size])
            for _ in range(rng.randrange(3)):
                block = f"<div class='{rng.choice(['row', 'col', 'part-' + str(k), 'text'])}'>{block}</div>"
            inner.append(block + (rng.choice(furniture) if rng.random() < 0.3 else ""))
            k += size
        body = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<article><div class='wrap'>{}</div></article>"]).format("".join(inner))
        for _ in range(rng.randrange(3)):
            body = f"<div class='page'>{rng.choice(furniture)}{body}{rng.choice(furniture)}</div>"
        rows.append((n, f"http://h{n % 3}.example/{n}", f"<html><head><title>t</title></head><body>{rng.choice(furniture)}{body}{rng.choice(furniture)}</body></html>"))
        expected[n] = "\n\n".join(story)
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == expected


def test_hosts_vote_and_winners_decide(spark):
    good = "<body><div class='story-{}'><p>{}</p></div><div class='x'><p>{}</p></div></body>"
    rows = [(i, f"https://News.example:80/{i}", good.format(i, "the story in many words, " * 4, "short")) for i in range(9)]
    # here the other box is longer, but the host's path holds enough of it
    rows += [(9, "http://u@news.example/q", good.format(9, "the story, told shorter than the rest " * 2, "a box of other text that goes on " * 3)), (10, None, None), (11, "nohost", "<p>alone</p>"), (10, None, None)]
    rows += [(None, "https://news.example/0", good.format(0, "a page without an id " * 4, "short")), (12, "https://news.example/12", "<article>" + "<p>many words here</p>" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash")).withColumn("host_", F.lit("clash"))
    found = {r["page_id"]: r for r in html_extraction.extract_pages(pages).collect()}
    assert found[9]["text"] == ("the story, told shorter than the rest " * 2).strip() and found[10]["text"] == "" and found[11]["text"] == "alone"
    assert found[None]["text"] == ("a page without an id " * 4).strip() and found[12]["text"].count("\n\n") == 49_999
    assert html_extraction.extract_pages(pages).count() == 15
    assert html_extraction.extract_pages(pages.limit(0)).count() == 0
    salted = html_extraction.BROADCAST_PATHS
    try:
        html_extraction.BROADCAST_PATHS = 0
        again = {r["page_id"]: r["text"] for r in html_extraction.extract_pages(pages).collect()}
    finally:
        html_extraction.BROADCAST_PATHS = salted
    assert again == {k: r["text"] for k, r in found.items()}


def test_pages_table_against_its_own_markup(spark, sf_dir):
    from html import unescape
    from re import split, sub

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for row in queries.op1_html_extraction(spark, sf_dir).collect():
        html = pages[row["page_id"]] or ""
        inner = html.partition("<article>")[2].partition("</article>")[0].replace("<br>", " ")
        blocks = [" ".join(unescape(sub("<[^>]*>", "", b)).split()) for b in split("</?(?:p|h1)>", inner)]
        assert row["text"] == "\n\n".join(b for b in blocks if b) and row["n_chars"] == len(row["text"])


# --- SentencePiece ------------------------------------------------------------------------------


def test_encoding_is_the_librarys(spark, documents, edge_docs, no_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    for docs in (documents.limit(60), edge_docs):
        texts = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
        got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in digests(encode_decode(docs, queries.piece_model())).collect())
        assert got == sorted((i, len(sp.encode(t)), sha(",".join(map(str, sp.encode(t)))), sha(sp.decode(sp.encode(t)))) for i, t in texts)
    assert encode_decode(no_docs, queries.piece_model()).count() == 0


def test_a_full_word_table_starts_anew():
    table, small = WordTable(queries.piece_model()), WordTable(queries.piece_model(), most=5)
    texts = [f"w{i} x{i % 3} " * 4 for i in range(50)]
    assert [x for t in texts for x in small.encode([t])] == list(table.encode(texts)) and len(small.ids) <= 5


# --- media --------------------------------------------------------------------------------------


def test_every_track(spark):
    """An audio track before the video hides nothing."""
    one = iso_media.mux(bytes(64 * 20))
    trak = one[one.index(b"trak") - 4 : one.index(b"mdat") - 4]
    # the same track again, named video, behind the others at the file's end so that offsets hold
    moov = one[one.index(b"moov") - 4 : one.index(b"mdat") - 4] + trak.replace(b"soun", b"vide").replace(b"raw ", b"avc1")
    both = one.replace(b"moov", b"free") + len(moov).to_bytes(4, "big") + moov[4:]
    files = spark.createDataFrame([(1, both)], "id long, data binary")
    got = {r["id"]: r for r in iso_media.media_columns(files, "id", "data").collect()}
    assert [(t["handler"], t["codec"], t["n_samples"], len(t["keyframes"])) for t in got[1]["tracks"]] == [("soun", "raw ", 20, 2), ("vide", "avc1", 20, 2)]
    assert got[1]["codec"] == "raw "


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def movie(*tables, duration=100, extra=b"", edits=b""):
    """A file of one video track whose sample tables are `tables`."""
    full = lambda kind, *parts: box(kind, bytes(4), *parts)
    stsd = full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(78)))
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, duration), bytes(4)), full(b"hdlr", bytes(4), b"vide", bytes(12)), box(b"minf", box(b"stbl", stsd, *tables)))
    trak = box(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, 7), bytes(68)), edits, mdia)
    return box(b"ftyp", b"isom", bytes(4)) + box(b"moov", trak, extra)


def table(kind, *numbers):
    return box(kind, bytes(4), struct.pack(f">{len(numbers)}I", *numbers))


def test_compact_sizes_edits_and_fragments():
    empty = [table(b"stts", 0), table(b"stsc", 0), table(b"stsz", 0, 0), table(b"stco", 0)]
    edits = box(b"edts", table(b"elst", 2, 5, 0xFFFFFFFF, 0x10000, 90, 40, 0x10000))
    # compact sizes of 4 bits: 3, 1 and 2 bytes in one chunk at byte 8
    small = [table(b"stts", 1, 3, 10), table(b"stsc", 1, 1, 3, 1), box(b"stz2", bytes(7), b"\4", struct.pack(">I", 3), b"\x31\x20"), table(b"stco", 1, 8), table(b"stss", 2, 1, 3)]
    d = iso_media.describe(movie(*small, edits=edits))
    assert (d["codec"], d["start"], d["n_samples"], d["keyframes"]) == ("avc1", 40, 3, [(0, 0, 8, 3), (2, 20, 12, 2)])
    for width, raw in ((8, b"\3\1\2"), (16, b"\0\3\0\1\0\2")):
        small[2] = box(b"stz2", bytes(7), bytes([width]), struct.pack(">I", 3), raw)
        assert iso_media.describe(movie(*small))["keyframes"] == [(0, 0, 8, 3), (2, 20, 12, 2)]
    # two fragments of two samples; only the first of each is a sync sample
    trex = box(b"mvex", table(b"trex", 7, 1, 50, 4, 0x10000))
    whole = movie(*empty, duration=0, extra=trex)
    expected = []
    for k in range(2):
        trun = box(b"trun", struct.pack(">IIiI", 0x5, 2, 0, 0x2000000))
        traf = box(b"traf", box(b"tfhd", struct.pack(">II", 0x20000, 7)), box(b"tfdt", struct.pack(">II", 0, 100 * k)), trun)
        length = len(box(b"moof", traf))
        moof = box(b"moof", traf.replace(struct.pack(">IIiI", 0x5, 2, 0, 0x2000000), struct.pack(">IIiI", 0x5, 2, length + 8, 0x2000000)))
        expected.append((2 * k, 100 * k, len(whole) + length + 8, 4))
        whole += moof + box(b"mdat", b"abcdefgh")
    d = iso_media.describe(whole)
    assert (d["n_samples"], d["duration"], d["keyframes"]) == (4, 200, expected)
    with pytest.raises(iso_media.Malformed):
        iso_media.describe(whole.replace(struct.pack(">IIi", 0x5, 2, length + 8), struct.pack(">IIi", 0x5, 0x7FFFFFFF, length + 8)))


def test_files_that_claim_too_much_give_null(spark):
    whole = iso_media.mux(bytes(range(256)) * 64)
    put = lambda kind, at, *numbers: (i := whole.index(kind) + 4 + at) and whole[:i] + struct.pack(f">{len(numbers)}I", *numbers) + whole[i + 4 * len(numbers) :]
    deep = b""
    for _ in range(3000):
        deep = struct.pack(">I4s", len(deep) + 8, b"moov") + deep
    huge = [put(b"stss", 8, 1_000_000), put(b"stss", 8, 0), put(b"stss", 8, 9, 9), deep, put(b"stsz", 4, 64, 4_000_000_000), put(b"stsz", 4, 1, 16_000_000), put(b"stts", 8, 4_000_000_000, 1), put(b"stts", 8, 4_000_000_000, 0), put(b"stsc", 8, 0), put(b"stsc", 4, 0), put(b"stss", 4, 4_000_000_000), put(b"co64", 8, 0xFFFFFFFF)]
    rng = random.Random(3)
    torn = [bytes(b if rng.random() > 0.004 else rng.randrange(256) for b in whole[:900]) + whole[900:] for _ in range(60)]
    files = spark.createDataFrame([(i, b) for i, b in enumerate([whole, *huge, *torn])], "id int, data binary")
    got = {r["id"]: r["codec"] for r in iso_media.media_columns(files, "id", "data").collect()}
    assert len(got) == 1 + len(huge) + len(torn) and got[0] == "raw " and all(got[i] is None for i in range(1, len(huge) + 1))


def test_media_query_against_its_contract(spark, sf_dir, documents):
    """Digests, checksums and feature from the texts and stored bytes alone, the container read by hand."""
    text = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    media = {r["doc_id"]: bytes(r["media"]) for r in iso_media.text_media(documents).collect()}
    for r in queries.op6_media_columns(spark, sf_dir).collect():
        raw = text[r["doc_id"]].encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        file = media[r["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest()) and file.endswith(payload)
        n, first = len(payload) // 64, len(file) - len(payload)
        ranges = b"".join(struct.pack(">4Q", k, 64 * k, first + 64 * k, 64) for k in range(0, n, 16))
        assert r["feature"] == f"codec=raw;timescale=8000;duration={len(payload)};samples={n};keyframes={-(-n // 16)};ranges={zlib.crc32(ranges):08x}"


def test_media_round_trip(spark, edge_docs, no_docs):
    seen = 0
    for row in iso_media.text_media(edge_docs).join(edge_docs.select("doc_id", "text").distinct(), "doc_id").collect():
        n, payload = iso_media.padded(row["text"])
        assert bytes(row["payload"]) == payload and row["n_bytes"] == n and len(payload) % 64 == 0 and payload
        d = iso_media.describe(bytes(row["media"]))
        assert d["codec"] == "raw " and d["duration"] == len(payload) and d["n_samples"] * 64 == len(payload)
        for k, time, at, size in d["keyframes"]:
            assert time == k * 64 and bytes(row["media"])[at : at + size] == payload[k * 64 : k * 64 + 64]
        seen += 1
    assert seen == edge_docs.count() and iso_media.text_media(no_docs).count() == 0


def test_other_layouts_and_broken_media(spark):
    payload = bytes(range(256)) * 64
    whole = iso_media.mux(payload)
    top = {k: (a, b) for k, a, b in iso_media.boxes(memoryview(whole))}
    assert set(top) == {b"ftyp", b"moov", b"mdat"} and iso_media.samples_of(whole) == payload
    free = whole + b"\0\0\0\x08free"
    assert iso_media.samples_of(free) == payload
    to_end = bytearray(whole)
    at = top[b"mdat"][0] - 16
    to_end[at : at + 4] = b"\0\0\0\0"  # size 0: to the end of the file
    assert [k for k, *_ in iso_media.boxes(memoryview(bytes(to_end)))] == [b"ftyp", b"moov", b"mdat"]
    broken = [None, b"", b"abc", whole[:500], whole[: len(whole) - 9], b"\0\0\0\x10moovjunkjunk", random.Random(1).randbytes(400)]
    files = spark.createDataFrame([(i, b) for i, b in enumerate([whole, *broken])], "id int, data binary")
    got = {r["id"]: r for r in iso_media.media_columns(files, "id", "data").collect()}
    assert got[0]["codec"] == "raw " and len(got[0]["keyframes"]) == 16 and all(got[i]["codec"] is None for i in range(1, len(broken) + 1))


# --- chat ---------------------------------------------------------------------------------------

HARD = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", r"<\|im_end|> <\\|x", "<<SYS>>a<</SYS>>", "\\", "[\\INST]", "<<|", "", None, "plain", "a\nb\n", "<|im_end|>" * 50]


def test_chat_reads_back(spark):
    rows = [(c, t, ("user", "assistant", "system", "as\\n\n<|s", None)[(c + t) % 5], HARD[(c * 3 + t) % len(HARD)]) for c in range(8) for t in range(1 + c * 2)]
    rows += [rows[0], (90, 0, "user", "only"), (91, 0, "assistant", "alone"), (91, 0, "assistant", "alone"), (None, 1, "assistant", "none"), (92, None, "assistant", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash")).withColumn("loss_start", F.lit(1))
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    found = {r["conv_id"]: r for r in chat_format.digests(chat_format.examples(table)).collect()}
    assert set(found) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        row = found[c]
        assert row["n_turns"] == len(turns) and row["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for *_, r, x in turns))
        assert row["loss_chars"] == len(loss) and row["loss_sha256"] == sha(loss)
    assert chat_format.digests(chat_format.examples(table.limit(0))).count() == 0


def test_a_very_long_conversation(spark):
    """A turn of a megabyte and a conversation of a thousand turns read back."""
    turns = [(1, 0, "user", "<|im_end|> [INST] " * 60_000), (1, 1, "assistant", "</s> é " * 40_000)]
    turns += [(2, t, "assistant" if t % 50 == 49 else "user", f"turn {t} <|x") for t in range(1000)]
    found = {r["conv_id"]: r for r in chat_format.digests(chat_format.examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    for c in (1, 2):
        own = [(r, x) for i, _, r, x in turns if i == c]
        loss = "".join(x for r, x in own if r == "assistant")
        assert (found[c]["n_turns"], found[c]["turns_sha256"]) == (len(own), sha("".join(f"{r}\n{x}\n" for r, x in own)))
        assert (found[c]["loss_chars"], found[c]["loss_sha256"]) == (len(loss), sha(loss))


def test_each_reply_is_one_example_with_its_context(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", "v"), (1, 4, "assistant", "b"), (1, 5, "user", "w")]
    got = chat_format.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("example").collect()
    assert [(r["example"], r["text"][r["loss_start"] : r["loss_start"] + r["loss_length"]]) for r in got] == [(3, "a"), (5, "b"), (6, "")]
    assert got[1]["text"].startswith(got[0]["text"]) and got[2]["is_whole"] and "<|im_start|>user\nw" not in got[1]["text"]


# --- fingerprints -------------------------------------------------------------------------------


def mix64(x):
    """The finaliser, in Python's own integers."""
    m = (1 << 64) - 1
    x = (x ^ x >> 32) * 0x9E3779B97F4A7C15 & m
    x = (x ^ x >> 29) * 0xC2B2AE3D27D4EB4F & m
    return x ^ x >> 32


def plain_order_minhash(text):
    """Order MinHash by its definition: number k-mers by occurrence, sort all by each selection's
    hash, put the first two back in text order."""
    if not text:
        return [0] * 64
    a, b, c, m = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, (1 << 64) - 1
    points = [ord(x) for x in text]
    if len(points) < 8:
        h = len(points)
        for p in points:
            h = mix64(h ^ p)
        hashes = [h]
    else:
        two = [(x * a + y) & m for x, y in zip(points, points[1:], strict=False)]
        two = [x ^ x >> 29 for x in two]
        four = [(x * b + y) & m for x, y in zip(two, two[2:], strict=False)]
        four = [x ^ x >> 32 for x in four]
        hashes = [mix64((x * c + y) & m) for x, y in zip(four, four[4:], strict=False)]
    seen, pairs = defaultdict(int), []
    for place, h in enumerate(hashes):
        pairs.append((mix64(((h >> 20) * c + seen[h >> 20]) & m), place))
        seen[h >> 20] += 1
    factors, terms = order_minhash.selectors()
    out = []
    for f, t in zip(factors[:, 0].tolist(), terms[:, 0].tolist(), strict=True):
        least = sorted(pairs, key=lambda p: (f * (p[0] >> 32) + t) & 0xFFFFFFFF)[:2]
        (x, _), (y, _) = sorted([least[0], least[-1]], key=lambda p: p[1])
        out.append(mix64((x * a + mix64((y + c) & m)) & m) >> 48 or 1)
    return out


def hexed(values):
    return "".join(f"{v:04x}" for v in values)


def test_fingerprints_against_brute_force(spark, edge_docs, no_docs):
    old = order_minhash.RANGE_ROWS
    rows = [(r["doc_id"], (r["text"] or "")[:9_000]) for r in edge_docs.select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range_", F.lit("clash"))
    rows.sort(key=lambda r: -r[0])
    share = lambda x, y: sum(p == q for p, q in zip(x, y, strict=True)) / 64
    plain = {t: plain_order_minhash(t) for _, t in rows}
    expected = set()
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        other = plain_order_minhash(edited)
        expected.add((i, n, sha(edited), hexed(plain[t]), hexed(other), share(plain[t], other), share(plain[t], plain[after])))
    try:
        for each in (2, 4_000):
            order_minhash.in_ranges.__defaults__ = (each,)
            got = order_minhash.edited_pairs(docs).collect()
            assert len(got) == len(rows) and {(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in got} == expected
    finally:
        order_minhash.in_ranges.__defaults__ = (old,)
    assert order_minhash.edited_pairs(no_docs).count() == 0
    one = order_minhash.edited_pairs(edge_docs.filter("doc_id = -3")).first()
    assert one["near_next"] == 1.0 and order_minhash.edited_pairs(edge_docs).count() == len(rows)


def test_blocks_of_a_long_text_select_the_same(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choices("abcde ", k=5_000))
    expected = plain_order_minhash(text)
    for block in (1, 7, 1000, 4_096):
        monkeypatch.setattr(order_minhash, "BLOCK", block)
        assert order_minhash.signature(order_minhash.points(text)).tolist() == expected


def test_likeness_follows_edits_and_order():
    rng = random.Random(3)
    base = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(400))
    sig = lambda t: order_minhash.signature(order_minhash.points(t))
    few = base[:900] + "XYZ" + base[910:]
    half = base[: len(base) // 2] + "".join(rng.choices("klmnopqrst ", k=len(base) // 2))
    other = "".join(rng.choices("abcdefghij ", k=len(base)))
    words = base.split()
    swapped = " ".join(words[200:] + words[:200])
    near = [order_minhash.likeness(sig(base), sig(t)) for t in (base, few, half, other)]
    assert near[0] == 1.0 and near[1] > 0.8 and near[1] > near[2] > near[3] and near[3] < 0.05
    assert order_minhash.likeness(sig(base), sig(swapped)) < 0.75  # the same k-mers in another order
    assert np.array_equal(sig("abc"), sig("abc")) and not np.array_equal(sig("abc"), sig("abd"))


def test_range_of_counts_cuts_below(spark):
    for n in (0, 1, 2, 3, 10, 57):
        cuts = [k * 3 for k in range(n)]
        got = spark.range(-2, 3 * n + 2).select("id", order_minhash.range_of(F.col("id"), cuts).alias("r")).collect()
        assert all(r["r"] == sum(c < r["id"] for c in cuts) for r in got)


# --- toxicity -----------------------------------------------------------------------------------


def test_pairs_of_terms_are_learned():
    """Neither term is toxic alone; both together are."""
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(1200):
        filler = [f"filler{rng.randrange(40)}" for _ in range(12)]
        a, b = i % 4 in (1, 3), i % 4 in (2, 3)
        texts.append(" ".join(filler + ["stinking"] * a + ["outgroup"] * b))
        labels.append(int(a and b))
    rows = [np.array(sorted({t for w in toxicity.text_words(x) for t in toxicity.word_terms(w)})) for x in texts]
    model = toxicity.fit(rows[:1000], np.array(labels[:1000]))
    assert all((model.score(t) >= 0.5) == bool(y) for t, y in zip(texts[1000:], labels[1000:], strict=True))


def test_pairs_of_terms_that_tell_nothing_alone():
    """Toxic with both terms or neither: each term stands in as many toxic rows as others."""
    rng = random.Random(7)
    texts, labels = [], []
    for i in range(1200):
        a, b = i % 4 in (1, 3), i % 4 in (2, 3)
        texts.append(" ".join([f"filler{rng.randrange(40)}" for _ in range(12)] + ["stinking"] * a + ["outgroup"] * b))
        labels.append(int(a == b))
    rows = [np.array(sorted({t for w in toxicity.text_words(x) for t in toxicity.word_terms(w)})) for x in texts]
    model = toxicity.fit(rows[:1000], np.array(labels[:1000]))
    assert all((model.score(t) >= 0.5) == bool(y) for t, y in zip(texts[1000:], labels[1000:], strict=True))


def test_exactly_one_of_two_words():
    """4,000 rows labelled by "exactly one of two words", no term of which tells anything alone."""
    rng = random.Random(9)
    texts, labels = [], []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join([f"filler{rng.randrange(60)}" for _ in range(15)] + ["stinking"] * a + ["outgroup"] * b))
        labels.append(int(a != b))
    rows = [np.array(sorted({t for w in toxicity.text_words(x) for t in toxicity.word_terms(w)})) for x in texts]
    model = toxicity.fit(rows[:3200], np.array(labels[:3200]))
    right = sum((model.score(t) >= 0.5) == bool(y) for t, y in zip(texts[3200:], labels[3200:], strict=True))
    assert right > 0.95 * 800


def test_score_is_the_sum_over_all_pairs():
    """The score against the plain double sum over pairs of terms."""
    rng = np.random.default_rng(2)
    texts = ["stinking outgroup of them", "stinking", "", None, "never seen words", "Outgroup OUTGROUP outgroups stink " * 20]
    terms = np.array(sorted({t for x in texts for w in toxicity.text_words(x) for t in toxicity.word_terms(w)} - set(toxicity.word_terms("seen"))))
    model = toxicity.Model(terms, -0.3, rng.normal(0, 0.4, len(terms)), rng.normal(0, 0.4, (len(terms), toxicity.RANK)))
    at = {int(t): i for i, t in enumerate(terms)}
    for text in texts:
        words = {w for w in "".join(c.lower() if c.isalnum() else " " for c in text or "").split()}
        found = sorted({at[t] for w in words for t in toxicity.word_terms(w) if t in at})
        z = model.bias + sum(model.weights[i] for i in found)
        z += sum(float(np.dot(model.factors[i], model.factors[j])) for k, i in enumerate(found) for j in found[k + 1 :])
        assert abs(model.score(text) - 1 / (1 + np.exp(-z))) < 1e-9


def test_scores_and_folds(spark, sf_dir, documents):
    got = queries.op10_toxicity(spark, sf_dir).collect()
    assert len(got) == documents.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_held_out_accuracy(spark):
    """On the larger of the small tables, unseen rows are told apart."""
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r["predicted"], labels[r["doc_id"]]) for r in queries.op10_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    right, caught = sum(a == b for a, b in got) / len(got), sum(a and b for a, b in got) / sum(b for _, b in got)
    assert right > 0.97 and caught > 0.8


def test_a_sample_of_too_many_terms_is_cut(spark, documents, monkeypatch):
    """Fewer rows are fitted where they hold too many terms; the first by hash stay."""
    seen = []
    real = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows, labels: seen.append(rows) or real(rows, labels))
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "STEPS", 1)
    labels = documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    toxicity.train(documents, labels)
    total = sum(map(len, seen[0]))
    monkeypatch.setattr(toxicity, "MAX_SAMPLE_TERMS", total // 2)
    toxicity.train(documents, labels)
    assert total // 4 < sum(map(len, seen[1])) <= total // 2 and {r.tobytes() for r in seen[1]} <= {r.tobytes() for r in seen[0]}


def test_repeats_of_an_id_are_one_row_of_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, labels: seen.append((rows, labels)) or toxicity.Model(np.zeros(0, dtype=np.int64), 0.0, np.zeros(0), np.zeros((0, toxicity.RANK))))
    hot = next(k for k in range(20) if zlib.crc32(str(k).encode()) % 5)
    docs = spark.range(30_000).select(F.lit(hot).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id") % 3).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(k, f"other {k}") for k in range(100, 110)], "doc_id long, text string"))
    toxicity.train(docs, spark.createDataFrame([(hot, 1), (hot, 0), *((k, 0) for k in range(100, 110))], "doc_id long, toxic int"))
    rows, labels = seen[0]
    assert len(rows) == 1 + sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(100, 110)) and sum(labels) == 1


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, (i % 2) if i else None) for i in range(13)] + [(3, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(edge_docs, labels)
    assert toxicity.score(edge_docs, model).count() == edge_docs.count() and toxicity.score(no_docs, model).count() == 0
    nothing = toxicity.train(no_docs, labels)
    assert toxicity.score(edge_docs, nothing).select("score").distinct().count() == 1
    kept = toxicity.clean(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == sum(r["score"] < 0.5 for r in toxicity.score(edge_docs, model).collect())


def test_workers_give_back_what_they_freed():
    import resource

    from scrivener.llm.common import give_back

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * resource.getpagesize() >> 20

    rows = [bytes(2000) for _ in range(100_000)]
    held = rows[-1]
    rows.clear()
    before = resident()
    give_back()
    assert resident() < before - 100 and len(held) == 2000
