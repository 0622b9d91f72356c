"""Vectors, pages and the pipeline."""

import gzip
import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import html, mixing, near_dups, neighbours, queries, warc

DATA = "/root/testdata/sf0.001"


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 32))
    x = np.concatenate([centres[k % 20] + rng.normal(size=32) for k in range(1500)]).reshape(-1, 32) * rng.uniform(0.5, 2.0, (1500, 1))
    x[700:720] = x[700]  # copies: ties go to the smaller id
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    found = {}
    for r in neighbours.nearest(df, every=20, k=20).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 1500, 20)) and all([r for r, _, _ in v] == list(range(1, 21)) for v in found.values())
    for q, rows in found.items():
        assert all(abs(s - (x[q] * x[i]).sum()) < 1e-9 and i != q for _, i, s in rows)
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
    assert neighbours.recall(x, np.arange(1500), {q: [i for _, i, _ in v] for q, v in found.items()}, 20) >= 0.9
    tied = [i for _, i, _ in found[700] if 700 < i < 720]
    assert tied == list(range(701, 701 + len(tied))) and len(tied) > 5


def test_neighbours_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], "x"), (20, [1.0, 2.0], "x"), (1, None, "x"), (2, [0.0, 0.0], "x"), (3, [float("nan"), 1.0], "x"), (4, [1.0, None], "x"), (5, [3.0, 1.0], "x"), (6, [3.0, 1.0], "x"), (7, [1.0], "x"), (None, [1.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = [(r.query_id, r.vec_id) for r in neighbours.nearest(df, every=20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 5), (0, 6), (0, 20), (20, 5), (20, 6), (20, 0)]
    assert neighbours.nearest(df.limit(0), every=20).count() == 0


def test_index_prunes_clustered_vectors():
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(200, 32))[:, None, :] + 0.08 * rng.normal(size=(200, 30, 32))).reshape(-1, 32)
    projection, radius, width = neighbours.fit(x, float(np.linalg.norm(x, axis=1).max()), 20)
    codes = neighbours.codes_of(neighbours.lifted(x, float(np.linalg.norm(x, axis=1).max())), projection)
    index = neighbours.MultiIndex(codes, width)
    asked = [neighbours.codes_of(np.append(q / np.linalg.norm(q), 0.0)[None, :], projection)[0] for q in x[:100]]
    assert np.mean([len(index.probed(q, radius)) for q in asked]) < 0.3 * len(x)


def test_index_probes_all_within_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (500, 8)).astype(np.uint16)
    codes[100:150] = codes[7] ^ (1 << rng.integers(0, 16, (50, 8))).astype(np.uint16)
    for radius, width in itertools.product((0, 1, 7, 8, 9, 40, 60, 128), neighbours.WIDTHS):
        index = neighbours.MultiIndex(codes, width)
        assert len(index.probed(codes[7], radius)) <= (60 if radius < 10 and width == 16 else 500)
        assert index.within(codes[7], radius).tolist() == np.flatnonzero(neighbours.hamming(codes[7], codes) <= radius).tolist()


def test_html_structure():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><p>Site</p></header><div class="cookie-notice">c</div><nav><ul><li>a<li>b</ul></nav>
      <main><h1>Head&amp;line</h1><p>One <b>bold</b>
      word<br>next<p>Two &eacute; &#8364;<script>var a="<p>no</p>"</script><aside>side</aside><form><input>q</form><div id="comments"><p>first!</p></div><ul><li>x<li>y</ul></main><footer>f</footer></body></html>"""
    article, _, dropped, marked = html.split_page(page)
    assert marked and article == ["Head&line", "One bold word next", "Two é €", "x", "y"] and "Site" in dropped and "first!" in dropped
    assert html.split_page("") == ([], [], [], False) and html.split_page("plain < text")[1] == ["plain < text"]
    assert html.split_page("<p>cut<script>never closed")[1] == ["cut"]


def test_html_hints_are_whole_tokens():
    body = """<body style="overflow:hidden"><article class="post" style="overflow-x: hidden"><h1 title="A hidden valley">valley</h1><h2 id="related-work">work</h2><section id="search-algorithms"><p>search</p></section>
      <section id="search"><p>exact</p></section><div id="social-impact" data-hidden="1" aria-label="Search hints">impact</div><div class="share-price">price</div><h3 id="comments">remarks</h3>
      <div hidden>gone1</div><div aria-hidden="true">gone2</div><div style="color:red; Display : none !important">gone3</div><div class="x Related">gone4</div><div role=navigation>gone5</div><div class="cookie_banner">gone6</div></article></body>"""
    article, _, dropped, marked = html.split_page(body)
    assert marked and article == ["valley", "work", "search", "exact", "impact", "price", "remarks"] and dropped == [f"gone{k}" for k in range(1, 7)]
    assert html.split_page("<body style='display:none' class=search><p>shown when loaded</p></body>")[1] == ["shown when loaded"]


def test_html_open_elements_end_where_others_start():
    assert html.split_page('<main><p class="ad">buy<p>real text<p>more</main>')[0] == ["real text", "more"]
    assert html.split_page('<main><ul><li class="ad">buy<ul><li>deal</ul><li>real</ul><p hidden>x<b>y</b><table><tr><td><p>cell</table></main>')[0] == ["real", "cell"]
    assert html.split_page('<main><dl><dt class="promo">a<dd>b</dl><table><tr class="ad"><td>c<tr><td class="ad">d<td>e</table></main>')[0] == ["b", "e"]
    assert html.split_page('<p class="ad"><span>sp</span> still ad</p>after')[1] == ["after"]


def test_html_boilerplate_by_host(spark):
    menu = "<div>Home About us Contact and help Shop now Sign in here</div>"
    rows = [(k, f"http://h.example/{k}", f"{menu}<p>page {k} has words of its own {k}a {k}b</p>") for k in range(30)] + [(100, "http://other.example/", f"{menu}<p>alone</p>"), (100, None, None), (101, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).repartition(3)
    for shard in (2000, 4):
        html.SHARD = shard
        got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html.extract_main_text(df).collect()}
        assert len(got) == len(rows)
        assert got[(3, "http://h.example/3")][0] == "page 3 has words of its own 3a 3b"
        assert got[(100, "http://other.example/")][0].startswith("Home About us") and got[(100, None)] == ("", 0)
    html.SHARD = 2000
    assert html.extract_main_text(df.limit(0)).count() == 0


def test_html_marks_are_evidence(spark):
    say = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    notice, shared = "All rights reserved by the owners of this site and its many helpers", "four score and seven years ago our fathers brought forth a nation"
    rows = [(k, f"<article><p>{say(k)}</p><p>{shared if k < 4 else say(100 + k)}</p><div>{notice}</div></article>") for k in range(12)]
    rows += [(50, f"<main></main><div>{say(50)}</div>"), (51, f"<article><p>a teaser</p></article><div>{say(51)}</div>"), (52, f"<div>{say(52)}</div><article class='comment'><p>{say(99, 60)}</p></article>")]
    rows += [(53, f"<article><p>{say(53)}</p><article class='comment'><p>first</p></article></article><div>outside {say(54, 9)}</div>"), (55, f"<article><p>{say(55)}</p></article><div>{notice}</div>")]
    df = spark.createDataFrame([(k, f"http://h.example/{k}", h) for k, h in rows], "page_id long, url string, html string").repartition(3)
    want = {k: f"{say(k)}\n{shared if k < 4 else say(100 + k)}" for k in range(12)} | {50: say(50), 51: f"a teaser\n{say(51)}", 52: say(52), 53: f"{say(53)}\noutside {say(54, 9)}", 55: say(55)}
    for shard in (2000, 4):
        html.SHARD = shard
        assert {r.page_id: r.text for r in html.extract_main_text(df).collect()} == want
    html.SHARD = 2000


def test_html_copies_count_once(spark):
    say = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    menu = "<div>Home About us Contact and help Shop now Sign in here</div>"
    rows = [(k, f"<nav>way {k}</nav>{menu}<p>{say(min(k, 20))}</p>") for k in range(30)]  # ten copies
    twice = [(100 + k, f"<div><p>{say(7)}</p></div>" if k else f"<div>{say(7)}</div>") for k in range(2)]
    both = [(k, f"http://h.example/{k}", h) for k, h in rows] + [(k, f"http://two.example/{k}", h) for k, h in twice]
    df = spark.createDataFrame(both, "page_id long, url string, html string").repartition(3)
    for shard in (2000, 4):
        html.SHARD = shard
        assert {r.page_id: r.text for r in html.extract_main_text(df).collect()} == {k: say(min(k, 20)) for k in range(30)} | {100: say(7), 101: say(7)}
    html.SHARD = 2000


def test_suffix_order_is_sorted():
    text = np.array([2, 1, 2, 1, 2, 1, 3, 1, 2, 1])
    order, rank = html.suffix_order(text, 4)
    keys = [tuple(text[i : i + 4]) for i in order]
    assert keys == sorted(keys) and all((rank[a] == rank[b]) == (tuple(text[a : a + 4]) == tuple(text[b : b + 4])) for a in range(10) for b in range(10))


def test_warc_round_trip(spark):
    evil = "dup é\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n"
    rows = [(1, "http://a\r\nb", None), (2, None, ""), (3, "u", evil), (4, "u", evil), (5, "u", "x" * 200_000), (None, "u", evil), (6, "u", "single")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    got = {r.page_id: r for r in warc.archive_round_trip(df).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("revisit", 4), 6: ("response", None)}
    assert got[3].payload_bytes == len(evil.encode()) and got[5].payload_bytes == 200_000 and got[1].payload_digest == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert got[1].url == "http://ab" and warc.archive_round_trip(df.limit(0)).count() == 0


def test_warc_files_are_bounded_and_seekable(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"page {k} " + "".join(hashlib.sha256(b"%d %d" % (k, i)).hexdigest() for i in range(60))) for k in range(60)] + [(100, "u", "y" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    index = warc.write_archives(df, f"file://{tmp_path}/w", file_bytes=20_000).collect()
    files = {p.name: p for p in (tmp_path / "w").iterdir()}
    assert {r.file for r in index} == set(files) and len(files) > 4 and all(n.endswith(".warc.gz") for n in files)
    payload = {k: h.encode() for k, _, h in rows}
    for r in index:
        data = files[r.file].read_bytes()
        assert r.offset < 20_000 and r.offset + r.length <= len(data)
        head, block = warc.parse(gzip.decompress(data[r.offset : r.offset + r.length]))
        assert int(head["Page"]) == r.page_id and bytes(block).partition(b"\r\n\r\n")[2] == payload[r.page_id]
    (tmp_path / "w" / "cut.warc.gz").write_bytes(files[index[0].file].read_bytes()[:-5])
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_archives(spark, f"file://{tmp_path}/w").count()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp('stage')}/{name}"
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_pipeline_keeps_clean_documents(spark, stages):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][:2] == ["quality_rules", "minhash_near_dedup"]
    assert all(s.columns == docs.columns for s in stages[:-1])
    clean = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").select("doc_id")
    long = docs.where(F.size(F.split("text", r"\s+")) >= 60).join(clean, "doc_id", "left_semi")
    kept = stages[0].join(clean, "doc_id", "left_semi").count()
    assert kept >= 0.98 * long.count()


def test_pipeline_decisions(spark, stages):
    before, after = stages[0], stages[1]
    verdicts = near_dups.near_duplicates(before, percent=80)
    assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in verdicts.where("kept").collect()}
    copies = {r.doc_id: r["count"] for r in stages[3].groupBy("doc_id").count().collect()}
    asked = {r.doc_id: r.copies for r in mixing.queue(stages[2]).where("copies > 0").collect()}
    assert copies == asked
    assert stages[4].count() == stages[3].count() and stages[4].where("n_tokens <> size(ids)").count() == 0


def test_queries_are_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)
