"""TIFF round trips (own and Java's), page labelling, vectors against brute force, and the pipeline."""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaywright.llm import embedding, html, tiff
from assaywright.llm._common import table
from assaywright.llm._pages import Maker

DATA = "/root/testdata/sf0.001"


# ---- TIFF
@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(compression, order):
    r = np.random.default_rng(3)
    for predictor in (1, 2):
        for tile in (0, 16):
            pages = [r.integers(0, r.choice([2, 256]), (int(r.integers(1, 150)), int(r.integers(1, 90)), int(r.choice([1, 3])))).astype(np.uint8) for _ in range(3)]
            got = list(tiff.read_pages(tiff.write_pages(pages, compression, predictor, rows=37, tile=tile, order=order)))
            assert len(got) == 3 and all((g["pixels"] == p).all() for g, p in zip(got, pages, strict=True))


def test_broken_tiff():
    raw = tiff.write_pages([np.arange(10000, dtype=np.uint8).reshape(100, 100)], tiff.LZW)
    for cut in range(0, len(raw), 7):
        list(tiff.read_pages(raw[:cut]))
    assert list(tiff.read_pages(b"II*\0\xff\xff\xff\xff")) == []


@pytest.mark.parametrize("name", ["LZW", "PackBits", "Deflate", "ZLib"])
def test_tiff_of_java(spark, name):
    """Another implementation's files are read alike."""
    j = spark.sparkContext._jvm
    x = np.random.default_rng(1).integers(0, 9, (70, 50)).astype(np.uint8)
    image = j.java.awt.image.BufferedImage(50, 70, 10)
    raster = image.getRaster()
    for (y, c), v in np.ndenumerate(x):
        raster.setSample(c, y, 0, int(v))
    writer = j.javax.imageio.ImageIO.getImageWritersByFormatName("tiff").next()
    how = writer.getDefaultWriteParam()
    how.setCompressionMode(2)
    how.setCompressionType(name)
    out = j.java.io.ByteArrayOutputStream()
    stream = j.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, j.javax.imageio.IIOImage(image, None, None), how)
    stream.close()
    page = next(tiff.read_pages(bytes(out.toByteArray())))
    assert (page["pixels"][:, :, 0] == x).all()


def test_op7(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, DATA, "documents").collect()}
    got = tiff.op7_media_tiff(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        b = docs[r["doc_id"]].encode()
        q = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(q), hashlib.sha256(q).hexdigest(), zlib.crc32(q[-64:]))


def test_media_edges(spark):
    """Null, empty, repeated and long texts, in every stored form, with names that clash."""
    texts = [None, "", "x" * 64, "x" * 65, "é" * 100, "ab" * 3000, "é" * 140_000, "line\n" * 60_000, "ab" * 3000]
    df = spark.createDataFrame([(k, t, "x", "own", 7) for k, t in enumerate(texts)], "id int, text string, page string, media string, width int")
    got = tiff.media_pages(tiff.with_media(df)).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r["id"]] or "").encode()
        assert bytes(r["payload"]) == raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0") and r["page"] == 0 and r["width"] == 64
    assert len({r["media"] for r in got if r["id"] in (5, 8)}) == 1 and len({r["feature"] for r in got if r["id"] in (5, 8)}) == 1
    assert {next(iter(tiff._directories(bytes(r["media"]))))[1][tiff.COMPRESSION][0] for r in got} == {tiff.PACKBITS, tiff.LZW, tiff.DEFLATE}
    assert any(tiff.TILE_AT in next(iter(tiff._directories(bytes(r["media"]))))[1] for r in got)
    assert tiff.media_pages(tiff.with_media(df.limit(0))).count() == 0
    same = tiff.media_pages(tiff.with_media(df.select("id", F.col("text").alias("media")), text="media")).collect()
    assert sorted(r["payload"] for r in same) == sorted(r["payload"] for r in got)


def test_a_page_that_claims_too_much():
    """A header of 4 billion samples over a few bytes is a broken page, and takes no memory; a page that is a thousandfold its bytes is not."""
    import struct

    raw = bytearray(tiff.write_pages([np.zeros((64, 64), np.uint8)]))
    at = struct.unpack_from("<I", raw, 4)[0] + 2
    for i in range(struct.unpack_from("<H", raw, at - 2)[0]):
        tag = struct.unpack_from("<H", raw, at + 12 * i)[0]
        if tag in (tiff.WIDTH, tiff.HEIGHT, tiff.ROWS):
            struct.pack_into("<I", raw, at + 12 * i + 8, 65_000)
    assert list(tiff.read_pages(bytes(raw))) == []
    for compression in (tiff.DEFLATE, tiff.LZW, tiff.PACKBITS, tiff.NONE):
        blank = np.zeros((4096, 512), np.uint8)
        assert (next(tiff.read_pages(tiff.write_pages([blank], compression, rows=4096)))["pixels"][:, :, 0] == blank).all()


def test_op7_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, feature string").write.parquet(f"{tmp_path}/documents.parquet")
    assert tiff.op7_media_tiff(spark, str(tmp_path)).count() == 0


# ---- pages
def test_blocks():
    page = "<!doctype html><head><title>T</title></head><body><nav><a href=x>N</a></nav><article><h1>A&amp;B</h1><p><b>one <i>t</i>wo<br>three<p>four&nbsp;five<script>x='<p>'</script><!-- <p>no</p> --></article><div class='ad \"x'>Buy</div>"
    assert [b.text for b in html.blocks(page)] == ["N", "A&B", "one two three", "four five", "Buy"]
    assert html.blocks("") == [] and html.blocks("<") != [] and [b.text for b in html.blocks("a < b")] == ["a < b"]


def test_gradients():
    m = html.Labeller()
    maker = Maker(5)
    pages = [p for p in (html.blocks(maker.page(), marks=True) for _ in range(3)) if p]
    d, y = [html.describe(p) for p in pages], np.concatenate([[b.mark for b in p] for p in pages]).astype(np.float32)
    _, g = m.gradients(d, y)
    for k in ("uf", "ub", "p", "m", "o"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, eps = m.w[k][at], 1e-2
        m.w[k][at] = old + eps
        up = m.gradients(d, y)[0]
        m.w[k][at] = old - eps
        down = m.gradients(d, y)[0]
        m.w[k][at] = old
        assert (up - down) / (2 * eps) == pytest.approx(g[k][at], rel=0.05, abs=1e-4)


def test_labeller_on_unseen_pages():
    m, maker = html.trained(), Maker(999)
    pages = [html.blocks(maker.page(), marks=True) for _ in range(150)]
    wrong = sum(int((k != np.array([b.mark for b in p])).sum()) for p, k in zip(pages, m.label(pages), strict=True))
    assert wrong / sum(map(len, pages)) < 0.02


def test_op8(spark):
    pages = {r["page_id"]: r["html"] for r in table(spark, DATA, "pages").collect()}
    for r in html.op8_html_extraction(spark, DATA).collect():
        a = pages[r["page_id"]]
        a = a[a.index("<article") : a.index("</article>")]
        want = " ".join(entities.unescape(re.sub(r"</?b>", "", re.sub(r"<(?:/?p|br|/?h1|/?article)[^>]*>", " ", a))).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_weights_are_of_this_recipe():
    with np.load(html.WEIGHTS, allow_pickle=False) as f:
        assert str(f["recipe"]) == html.recipe()


def test_training_learns():
    """The stored weights come from this: a few pages already halve the error of no model."""
    small, maker = html.fit(400, 4, 5), Maker(77)
    pages = [html.blocks(maker.page(), marks=True) for _ in range(60)]
    wrong = sum(int((k != np.array([b.mark for b in p])).sum()) for p, k in zip(pages, small.label(pages), strict=True))
    assert wrong / sum(map(len, pages)) < 0.1


def test_html_edges(spark):
    rows = [(1, None), (2, ""), (3, "<script>only</script>"), (4, "<p>" * 3000 + "A word or two stood here, and that was all of it."), (5, "<article><p>Same page.</p></article>"), (5, "<article><p>Same page.</p></article>"), (6, "<!-- never closed <p>x"), (7, "<title>T</title><svg>"), (8, " \n\t ")]
    df = spark.createDataFrame([(*r, "own", "own", 3) for r in rows], "id int, html string, text string, n_chars string, url int")
    got = sorted((r["id"], r["text"], r["n_chars"], r["url"]) for r in html.extract(df).collect())
    assert got == [(1, "", 0, 3), (2, "", 0, 3), (3, "", 0, 3), (4, rows[3][1][9000:], 49, 3), (5, "Same page.", 10, 3), (5, "Same page.", 10, 3), (6, "", 0, 3), (7, "", 0, 3), (8, "", 0, 3)]
    assert html.extract(df.limit(0)).count() == 0
    same = html.extract(df.select("id", F.col("html").alias("text")), html="text")  # the page column has the result's name
    assert same.columns == ["id", "text", "n_chars"] and sorted(map(tuple, same.collect())) == [x[:3] for x in got]


def test_op8_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id bigint, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = html.op8_html_extraction(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 0


PARTS = [
    "The river rose again on Monday, and the council met to discuss new flood defences for the old town.",
    "Officials said that the cost would be shared, although nobody could say yet how much it would be.",
    "Residents remember the flood of 1998 well.",
    "We lost everything, said one of them, who has lived there for forty years.",
    "Work is to begin in spring.",
    "The last wall was built a century ago and has cracked in several places.",
]
BODY = "<h1>Flood defences</h1>" + "".join(f"<p>{x}</p>" for x in PARTS)
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul>'


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{BODY}</body>", f"<body><div class=container>{BODY}</div></body>", f"<div id=x1>{BODY}</div>", f"<body>{MENU}{BODY}</body>", f"<table><tr><td>{MENU}</td><td>{BODY}</td></tr></table>", f"<article>{BODY}</article>",
        f"<header><a href=/>Logo</a></header><main>{BODY}</main><footer>About us</footer>", f"<div class='cookie-banner'><p>We use cookies to improve your experience.</p><button>Accept</button></div><main>{BODY}</main><aside><p>Subscribe to our newsletter.</p></aside>",
        f"<div class=wrapper><div class=navigation><a href=/>Home</a> <a href=/a>About</a></div><div class=post>{BODY}</div><div class=sidebar><h3>Related</h3><ul><li><a href=/x>Something else happened</a></li></ul></div><div id=comments><h3>2 Comments</h3><div class=comment><p>What a good article, I thought so too.</p></div></div><div id=footer>Copyright 2024</div></div>",
        "<body>" + "<div>" * 401 + "<nav><a href=/>Home</a></nav>" + "</div>" * 401 + f"<article>{BODY}</article></body>", "<i>" * 2000 + f"<nav><a href=/>Home</a></nav><article>{BODY}</article>",
    ],
)
def test_pages_made_by_hand(page):
    p = html.blocks(page)
    assert [b.text for b, k in zip(p, html.trained().label([p])[0], strict=True) if k] == ["Flood defences", *PARTS]


def test_one_paragraph_is_main_text():
    for page in (f"<body><p>{PARTS[0]}</p></body>", PARTS[0], f"<article>{PARTS[0]}</article>"):
        p = html.blocks(page)
        assert html.trained().label([p])[0].tolist() == [True]


def test_deep_elements_count():
    nav = html.blocks("<div>" * 900 + "<nav><a href=x>Home</a></nav>")[0]
    assert html._bucket("t:nav") in nav.path and html._bucket("i:nav") in nav.path and nav.linked == 4
    many = html.blocks('<div class="' + " ".join("a" * k for k in range(1, 40)) + ' sidebar">x</div>')[0]
    assert html._bucket("n:sidebar") in many.path


@pytest.mark.parametrize(
    "page", ["<a " * 340_000, '<a b=">"' * 120_000, "<div>" * 200_000, "<b>" * 100_000 + "<div>x</div>" * 50_000, "<svg>" * 200_000, "<script>" + "</script " * 100_000, "<! " * 300_000, "<ul>" + "<b>" * 100_000 + "<li>x</li>" * 50_000, "<a '\"=\"'" * 100_000 + ">", "<" * 10**6, "&" * 10**6]
)
def test_time_is_linear(page):
    import time

    began = time.process_time()
    html.blocks(page)
    assert time.process_time() - began < 5  # a quadratic reader takes minutes


def test_long_pages_are_labelled_whole(monkeypatch):
    maker = Maker(31)
    pages = [html.blocks(maker.page()) for _ in range(40)]
    m = html.trained()
    whole = m.label(pages)
    monkeypatch.setattr(html, "LONG", 7)
    for p, k in zip(pages, whole, strict=True):
        if p:
            score = m.score_long(p)
            assert ((score > 0) == k).all() and np.allclose(score, m.forward([html.describe(p)])[0], atol=1e-3)


# ---- vectors
def vectors_brute(rows: list, t: float = 0.95) -> dict:
    n, par, links = len(rows), list(range(len(rows))), [0] * len(rows)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    unit = [np.array(v, float) / np.abs(np.array(v, float)).max() if k else None for k, (_, v) in zip(ok, rows, strict=True)]
    unit = [None if u is None else u / np.sqrt((u * u).sum()) for u in unit]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= t:
                links[i] += 1
                links[j] += 1
                p, q = root(i), root(j)
                par[max(p, q)] = min(p, q)
    groups: dict[int, list] = {}
    for i in range(n):
        groups.setdefault(root(i), []).append(rows[i][0])
    return {rows[i][0]: (links[i], min(groups[root(i)])) for i in range(n)}


@pytest.mark.parametrize("block_bytes", [60 * 96, 4 << 20])
def test_vectors(spark, block_bytes):
    r = np.random.default_rng(0)
    base = r.normal(size=(20, 12))
    rows = [(i * 3 + 1, (base[i % 20] + r.normal(size=12) * r.choice([0.05, 0.2, 0.5])).astype(np.float32).tolist()) for i in range(300)]
    rows += [(5001, None), (5002, [0.0] * 12), (5003, [float("nan")] * 12), (5004, [1.0, None] + [0.0] * 10), (5005, []), (5006, [1.0, 2.0]), (5007, [2.0, 4.0]), (5008, rows[0][1]), (5009, rows[0][1])]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    got = {x["id"]: x for x in embedding.near_duplicates(df, "id", "v", block_bytes=block_bytes).collect()}
    assert {i: (x["n_links"], x["component_id"]) for i, x in got.items()} == vectors_brute(rows)
    assert all(x["kept"] == (i == x["component_id"]) for i, x in got.items())
    assert embedding.near_duplicates(df.limit(0), "id", "v").count() == 0


def test_multiples_of_one_vector(spark):
    """All first coordinates tie: blocks stay small, and no pair is lost or made twice."""
    n, rows = 6000, 500
    counts = np.zeros(embedding.BINS, np.int64)
    counts[[70, 500, 40_000]] = 50_000, 30, 200
    first, several, lo, hi = embedding.blocks_of(counts, rows, 0.32)
    assert several[70] == 100 and first[500] == 100 and first[40_000] == 100 and (lo[:101] == 0).all() and (hi[:100] == 100).all()  # the next block begins within reach
    df = spark.range(n).selectExpr("id", "transform(array(3d, -1d, 2d, 0.5d), x -> x * (1 + id / 7d)) as v")
    got = embedding.near_duplicates(df, "id", "v", block_bytes=rows * 32).groupBy("n_links", "component_id").count().collect()
    assert [tuple(r) for r in got] == [(n - 1, 0, n)]


def test_cosines_at_the_threshold(spark):
    """Cosines of exactly 0.95 link, the next ones below don't, whatever the lengths and however dense the tile."""
    at = [20.0, 0.0, 0.0, 0.0, 0.0], [19.0, 6.0, 1.0, 1.0, 1.0]
    rows = [(1, list(at[0])), (2, list(at[1])), (3, [x * 7 for x in at[1]]), (4, [x * 2.0**600 for x in at[0]]), (5, [x * 3 * 2.0**-600 for x in at[1]]), (6, [19.0, 6.0, 1.0, 1.0, 1.0000001])]
    far = np.random.default_rng(4).normal(size=(400, 5)) - [9, 0, 0, 0, 0]  # a dense cluster, and many apart
    wide = np.eye(5)[np.arange(900) % 5] * -1.0 + np.random.default_rng(5).normal(size=(900, 5)) * 0.05
    for more in (far, np.abs(wide) * [-1, -1, -1, -1, -1]):
        df = spark.createDataFrame(rows + [(100 + i, v.tolist()) for i, v in enumerate(more)], "id bigint, v array<double>")
        for size in (1 << 22, 4000):
            got = {r["id"]: (r["n_links"], r["component_id"]) for r in embedding.near_duplicates(df, "id", "v", block_bytes=size).filter("id < 100").collect()}
            assert got == {1: (4, 1), 4: (4, 1), 2: (5, 1), 3: (5, 1), 5: (5, 1), 6: (3, 1)}, got


def test_op10_edges(spark, tmp_path):
    rows = [(1, [1.0, 0.0], "x", 1), (1, [1.0, 0.0], "x", 1), (2, None, "x", 1), (3, [0.0, 0.0], "x", 1), (4, [2.0, 0.0], "x", 1), (5, [float("inf"), 1.0], "x", 1)] + [(10 + k, [1.0] * k, "x", 1) for k in range(1, 30)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, kept string, component_id int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, embedding.op10_embedding_near_dedup(spark, str(tmp_path)).collect()))
    alone = [(i, 0, i, True) for i in [2, 3, 5] + [10 + k for k in range(1, 30)] if i != 12]
    assert [g for g in got if g[0] not in (1, 4, 12)] == alone
    assert [g for g in got if g[0] in (1, 4)] == [(1, 2, 1, True), (1, 2, 1, True), (4, 2, 1, False)]


# ---- pipeline
def test_pipeline_stages(spark):
    import corpus_pipeline as c

    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1) for r in table(spark, DATA, "documents").collect()]
    rows += [(9001, None, None, None, None, 1), (9002, "", "en", "s", 0, 1), (9003, "!!! 123", "en", "s", 7, 1), (rows[0][0], *rows[0][1:])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept int")
    seen = []
    for name, stage in c.STAGES:
        docs = c.stored(stage(spark, docs, DATA), name)
        seen.append((name, docs.count()))
        if name != c.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
            assert docs.filter("n_chars <> length(text)").count() == 0
    assert seen[0][1] == 201 and seen[1][1] == seen[2][1] == seen[3][1] < 201
    tot = docs.groupBy("sequence_id").sum("length").collect()
    assert all(r["sum(length)"] <= 1024 for r in tot)


def test_pipeline_of_nothing(spark):
    import corpus_pipeline as c

    docs = table(spark, DATA, "documents").limit(0)
    for name, stage in c.STAGES:
        docs = c.stored(stage(spark, docs, DATA), name)
        assert docs.count() == 0


def test_vectors_sql(spark):
    import duckdb

    from assaywright.llm.queries import oracle_sql

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    want = sorted(con.sql(oracle_sql()["op10_embedding_near_dedup"]).fetchall())
    got = embedding.op10_embedding_near_dedup(spark, DATA).select("vec_id", "n_links", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == want


def test_head_ends_without_body_tag():
    from assaywright.llm import html as pages

    for more in ("", "</article>"):
        got = [b.text for b in pages.blocks(f"<head><title>About <b>T</b></title><meta charset=x><script>a<p></script><article><p>First text.<p>Second <i>text</i>.{more}")]
        assert got == ["First text.", "Second text."]
    assert [b.text for b in pages.blocks("<head><title>T</title></head><body><p>Text.</body>")] == ["Text."]
