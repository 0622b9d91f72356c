"""Extreme ids, and input columns that are called as the operators' own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import audit, html, lines, manifest, mixing, near_dups, quality, substrings

LEAST, MOST = -(2**63), 2**63 - 1
W = " ".join(f"w{i}" for i in range(20))
#: What operators and stages call columns of their own.
OWN = ["__id", "__mark", "__void", "__start", "__count", "__text", "__words", "__removed", "__kept", "__copies", "__copy", "__text_mark", "__page", "__host", "__html", "__packed", "__key", "__c0", "__c1", "__lines",
       "__at", "__task", "__first", "__before", "__rows", "place", "slot", "size", "target", "taken", "copies", "block", "pos", "total", "digest", "group", "mask", "part", "docs", "hash", "row", "id", "n", "kept", "n_words", "base_failed", "text_", "component_id"]


@pytest.mark.parametrize("cuts", [(), (0.3, 0.6)])
def test_extreme_ids_are_ids(spark, cuts):
    rows = [(LEAST, W), (1, W), (MOST, W + " end"), (None, "q " + W), (None, W), (MOST, "own " + " ".join(f"z{i}" for i in range(15))), (None, "x " + " ".join(f"z{i}" for i in range(15))), (0, "y"), (5, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words), r.n_removed) for r in substrings.removal_digests(df, cuts=cuts).collect())
    want = sorted(((d is None, d or 0, len(t.split())), {LEAST: 0, 1: 20}.get(d, 20 if W in t else 15 if d is None else 0)) for d, t in rows)
    assert got == want


@pytest.fixture(scope="module")
def named(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    return docs.select("*", *(F.lit(f"keep {c}").alias(c) for c in OWN)).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_any_names(spark, named, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, named, "/root/testdata/sf0.001")
    if name == "bpe_encode":
        assert out.count() == 60
        return
    assert out.columns == named.columns
    rows = out.collect()
    assert rows and all(r[c] == f"keep {c}" for r in rows for c in OWN)


def test_operators_take_any_names(spark, named):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert audit.audit(named, labels).count() > 0
    cleaned = lines.dedup_lines(named)
    assert cleaned.columns == [*named.columns, "n_lines", "n_dropped"] and cleaned.where("__key = 'keep __key'").count() == 60
    assert manifest.manifest_check(named).where("verified").count() > 0
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("*", *(F.lit(f"keep {c}").alias(c) for c in OWN))
    out = html.extract_main_text(pages)
    assert out.columns == [c for c in pages.columns if c != "html"] + ["text", "n_chars"] and out.where("__page = 'keep __page'").count() == pages.count()
    assert mixing.queue(named).count() == 60 and near_dups.near_duplicates(named, percent=85).count() == 60 and quality.quality_verdicts(named).count() == 60


def test_toxicity_without_labels_follows_the_lexicon(spark):
    from tessera.llm import toxicity

    mild = [f"the weather in town {k} is nice today and the garden grows well" for k in range(60)]
    rude = ["you are a stupid idiot", "what a pathetic loser , stupid and dumb"] + [f"he said that number {k} is a moron and a jerk" for k in range(8)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(mild + rude)] + [(900, None), (901, "")], "doc_id long, text string")
    schema = "doc_id long, quality int, toxic int"
    for labels in (spark.createDataFrame([], schema), spark.createDataFrame([(k, 1, 0) for k in range(20)], schema)):
        score = {r.doc_id: (r.score, r.predicted) for r in toxicity.score_toxicity(df, labels).collect()}
        worst_mild = max(score[k][0] for k in range(60))
        assert min(score[k][0] for k in range(60, 70)) > worst_mild and score[900][0] == score[901][0] <= worst_mild
        assert all(score[k][1] == 1 for k in (60, 61)) and not any(score[k][1] for k in (*range(60), 900, 901))


def test_every_code_point_is_parted_as_the_library_does():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.llm import bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    mine, library = bpe.Merges(path), Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    texts = [f"A{chr(c)}b {chr(c)}1!{chr(c)}?" for c in (*range(0x20000), *range(0x2FA00, 0x32500), *range(0xE0000, 0xE0200)) if not 0xD800 <= c < 0xE000]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, ids in zip(texts, want) if [i for token in mine.tokens_of(t) for p in mine.pieces_of(token) for i in mine.merge(p)] != ids]
    assert len(wrong) == 0, [hex(ord(t[1])) for t in wrong[:20]]
