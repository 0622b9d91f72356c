"""Filter interactions, line dedup and the manifest, against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import audit, lines, manifest

WORD = r"[^\x20\x09-\x0D]+"
LONG = " ".join(f"w{i}" for i in range(60_000))
TEXTS = [
    (1, "same text", "en"), (2, "same text", "de"), (2, "same text", "en"), (1, "same text", None), (None, "same text", "en"), (3, None, "en"), (4, "", ""), (5, "A" * 40 + " $", "de"),
    (6, " ".join(f"u{i}" for i in range(250)), "de"), (7, " ".join(f"u{i}" for i in range(250)), "fr"), (7, "x " * 300, "fr"), (8, LONG, "fr"), (9, LONG, "en"), (-(2**63), LONG, "en"), (2**63 - 1, "é🙂 Ü|", None),
    (10, "a\x0bb\x1cc\x85d", "en"), (0, "same text", "fr"),
]
LABELS = [(1, 1, 0), (2, 1, None), (2, 0, 1), (None, 1, 1), (6, None, None), (7, 1, 1), (99, 1, 1), (0, 1, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, p, "s", 1, 2) for d, t, p in TEXTS], "doc_id long, text string, lang string, source string, mask int, part int").repartition(5)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def mask_of(doc_id, text):
    text = text or ""
    words = re.findall(WORD, text)
    least = min((d for d, t, _ in TEXTS if (t or "") == text and d is not None), default=None)
    fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), doc_id is not None and doc_id > least]
    return sum(f << k for k, f in enumerate(fails))


def audited():
    good, toxic = ({r[0] for r in LABELS if r[k] == 1 and r[0] is not None} for k in (1, 2))
    rows, shapley = {}, Counter()
    for part in {p or "" for _, _, p in TEXTS}:
        mine = [(d, mask_of(d, t)) for d, t, p in TEXTS if (p or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone, now = [x for x in left if x[1] & bit], [x for x in left if not x[1] & bit]
                failing = sum(1 for _, m in mine if m & bit)
                rows[part, "".join(order), step] = (len(now), len(gone), failing - len(gone), sum(m == bit for _, m in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone))
                shapley[part, f] += len(gone)
                left = now
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


@pytest.mark.parametrize("held", [32 << 20, 5])
def test_filter_interactions(spark, docs, labels, held, monkeypatch):
    monkeypatch.setattr(audit, "HELD", held)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(docs, labels).collect()}
    assert got == audited()
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_chains_part_texts_of_one_fingerprint():
    routed = [(5, (b"a", 3, 0, "x", 1)), (5, (b"b", 2, 1, "x", 1)), (5, (b"a", 1, 0, "y", 2)), (5, (b"a", 1, 0, "x", 1)), (5, (b"b", 9, 1, "x", 4)), (6, (None, 7, 16, "z", 1)), (7, (b"a", 8, 0, "x", 1))]
    assert sorted(audit.settle(iter(routed))) == sorted([(3, "x", 16, 1), (1, "y", 0, 2), (1, "x", 0, 1), (2, "x", 1, 1), (9, "x", 17, 4), (7, "z", 16, 1), (8, "x", 0, 1)])


def test_copies_of_a_hot_text_are_settled_before_they_are_routed():
    routed = list(audit.route((k, "en", "hot") for k in range(1000)))
    assert sum(text is not None for _, (text, *_) in routed) == 1 and len({key for key, _ in routed}) > 900


def cleaned(rows, known, threshold=3, least=1):
    def keys(t):
        return [re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({k: k + 32 for k in range(65, 91)}) for x in (t or "").split("\n")]

    counts = Counter(k for t in known for k in set(keys(t)) if len(k) >= least)
    out = []
    for t in rows:
        pairs = list(zip((t or "").split("\n"), keys(t)))
        kept = [x for x, k in pairs if counts[k] < threshold]
        out.append(("\n".join(kept), len(pairs), len(pairs) - len(kept)))
    return out


def random_texts(n, seed):
    rng = np.random.default_rng(seed)
    pool = ["", "  ", "Hello", " hello ", "HELLO\x0b", "é", "É", "x", "long " * 3000, "\x1cq", "q"] + [f"line {k}" for k in range(12)]
    return [None if rng.random() < 0.05 else "\n".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(0, 9))) for _ in range(n)]


def frame(spark, texts, first=0):
    return spark.createDataFrame([(None if k % 7 == 3 else k // 2, t, k, "extra") for k, t in enumerate(texts, first)], "doc_id long, text string, n_lines int, `key` string").repartition(3)


@pytest.mark.parametrize("sent, shard_keys", [(64 << 20, 1 << 20), (64 << 20, 2), (-1, 2)])
def test_line_index_follows_insertions_and_deletions(spark, sent, shard_keys, monkeypatch):
    monkeypatch.setattr(lines, "SENT", sent)
    monkeypatch.setattr(lines, "HELD", 200)
    one, two, three = (random_texts(n, s) for n, s in ((14, 1), (10, 2), (8, 3)))
    index = lines.LineIndex(spark, threshold=3, shard_keys=shard_keys)
    state = lambda: {r.key: r.docs for r in index.frequent().collect()}

    def right(texts, known):
        got = Counter((r.text, r.n_lines, r.n_dropped) for r in index.clean(frame(spark, texts)).collect())
        assert got == Counter(cleaned(texts, known))

    index.insert(frame(spark, one))
    right(one, one)
    after_one = state()
    index.insert(frame(spark, two))
    right(one + two, one + two)
    index.insert(frame(spark, three))
    assert index.shards > 1 or shard_keys > 2
    right(two, one + two + three)
    index.delete(frame(spark, two)).delete(frame(spark, three))
    assert state() == after_one and index.changes["ceased"] > 0
    right(one, one)
    with pytest.raises(ValueError):
        index.delete(frame(spark, ["never seen"]))
    right(one, one)
    index.delete(frame(spark, one))
    assert index.counts.count() == 0 and state() == {}


def test_line_dedup_odd_rows(spark):
    texts = ["a\nB \n\nc", "A\nb", " a ", "a", None, "", "\n", "b"] * 2
    df = frame(spark, texts)
    out = lines.dedup_lines(df, threshold=8)
    assert out.columns == ["doc_id", "text", "key", "n_lines", "n_dropped"]
    assert Counter((r.text, r.n_lines, r.n_dropped) for r in out.collect()) == Counter(cleaned(texts, texts, 8))
    assert lines.dedup_lines(df.limit(0)).count() == 0
    assert Counter((r.text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(df, 6, 2).collect()) == Counter(cleaned(texts, texts, 6, 2))
    got = lines.line_digests(df)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"] and got.where(F.length("kept_sha256") == 64).count() == 16


def test_cuckoo_filter_holds_what_is_in_it():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 2**64, 3000, np.uint64, endpoint=False)
    made = lines.CuckooFilter.over(hashes.tolist())
    assert made.accepts(hashes).all() and made.accepts(rng.integers(0, 2**64, 100_000, np.uint64)).sum() <= 2
    assert all(made.delete(int(h)) for h in hashes[:1000]) and made.accepts(hashes[1000:]).all() and made.accepts(hashes[:1000]).sum() <= 1
    assert not made.delete(int(hashes[0])) or made.accepts(hashes[1000:]).all()
    assert all(made.insert(int(h)) for h in hashes[:1000]) and made.accepts(hashes).all()


def test_exceptions_make_filters_exact(spark, monkeypatch):
    """With fingerprints of one bit nearly every key is accepted; what isn't frequent is spared all the same."""
    monkeypatch.setattr(lines.CuckooFilter, "accepts", lambda self, hashes: np.ones(len(hashes), bool))
    texts = ["a\nb", "a\nc", "a\nd", "b"]
    index = lines.LineIndex(spark, threshold=3).insert(frame(spark, texts))
    verdict = index.exceptions.count()
    assert verdict in (0, 3)  # workers that were forked before see the true filter
    assert Counter(r.text for r in index.clean(frame(spark, texts)).collect()) == Counter(["b", "c", "d", "b"])


def test_key_hash_is_sparks(spark):
    keys = ["", "a", "é🙂", "x" * 1000]
    got = spark.createDataFrame([(k.encode(),) for k in keys], "k binary").select(F.xxhash64("k")).collect()
    assert [r[0] % 2**64 for r in got] == [lines.key_hash(k.encode()) for k in keys]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle(rows, fanout):
    """rows: (doc_id, source, lang, n_chars, text); {(row): [(leaf, subroot, root, siblings, folded)]}."""
    frame_of = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha(*map(frame_of, r))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha(*last[k : k + fanout]) for k in range(0, len(last), fanout)])
        return levels

    def path(levels, at):
        out = []
        for nodes in levels[:-1]:
            lo = at // fanout * fanout
            out.append((nodes[lo:at], nodes[at + 1 : lo + fanout]))
            at //= fanout
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in g]) for s, g in groups.items()}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for s, g in groups.items():
        for at, r in enumerate(g):
            steps = path(trees[s], at) + path(top, names.index(s))
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            digest = leaf((*r[:4], r[4] and r[4].translate({k: k + 32 for k in range(65, 91)}))) if hit else leaf(r)
            for before, after in steps:
                digest = sha(*before, digest, *after)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha(*(x for b, a in steps for x in b + a)), digest, digest == top[-1][0]))
    return out


def merkle_rows(n, sources, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(k), f"s{rng.integers(0, sources)}" if rng.random() > 0.3 else "hot", "en", 5, f"Text {k}") for k in range(n)]
    rows += [(None, "hot", None, None, None), (None, None, "", 0, ""), (3, "", "x", 1, "É"), (5, "ü", None, 2**40, "A\nB"), (5, "ü", "a", 2, "Ab"), (5, "ü", "a", 2, "Ab"), (-(2**63), "hot", "a", 1, "Q" * 90_000), (7, None, "a", 1, "Z")]
    return rows


@pytest.mark.parametrize("n, sources, fanout, levels", [(60, 3, 16, 3), (90, 5, 2, 2), (40, 30, 3, 1), (1, 1, 16, 3)])
def test_manifest_equals_brute_force(spark, monkeypatch, n, sources, fanout, levels):
    rows = merkle_rows(n, sources)
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, pos string").repartition(4)
    monkeypatch.setattr(manifest.manifest, "__defaults__", (*manifest.manifest.__defaults__[:4], fanout, levels))
    got = [tuple(r) for r in manifest.manifest_check(df).collect()]
    assert sorted(got, key=str) == sorted(merkle(rows, fanout), key=str)


def test_manifest_of_nothing_and_of_one(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert manifest.manifest_check(spark.createDataFrame([], schema)).count() == 0
    (only,) = manifest.manifest(spark.createDataFrame([(1, "a", "b", 1, "c")], schema)).collect()
    assert only.path == [] and only.leaf == only.subroot == only.root == sha("1:1", "1:a", "1:b", "1:1", "1:c")
