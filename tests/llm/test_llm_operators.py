"""Operators against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablefold.llm import ann, html_extract, mixing, ngram_join, packing, pii, quality, rollup, simhash, span_dedup
from tablefold.llm.queries import vocabulary

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SMOKE = "/root/testdata/sf0.001"


def sample(seed=3, n=60):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)]
    base = [" ".join(r.choice(vocab) for _ in range(r.choice([1, 4, 20, 120]))) for _ in range(n // 3)]
    rows = []
    for i in range(n):
        words = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 6])):
            words[r.randrange(len(words))] = r.choice(vocab)
        rows.append((i * 7, " ".join(words)))
    passage = " ".join(vocab[:30])
    rows += [(100000, None), (100001, ""), (100002, " \t\n"), (100003, "É" * 10), (100004, "Only One"), (100005, "only one"),
             (100006, passage + " tail a"), (100007, "head " + passage), (100008, "x " * 30_000), (100009, "x " * 29_000)]
    return rows


def sets(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").encode().lower())
        out[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[j:j + 5]) for j in range(len(w) - 4)])
    return out


def test_ngram_join(make):
    rows = sample()
    s = sets(rows)
    ids = sorted(s)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]) and comp[a] != comp[b]:
                    low, high = sorted((comp[a], comp[b]))
                    comp = {k: low if v == high else v for k, v in comp.items()}
                    changed = True
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_classes(make(rows)).collect()}
    assert got == {i: (len(s[i]), comp[i]) for i in ids}


def test_ngram_join_group_of_edited_copies(make):
    """Copies of one text with few to many edits, some of them alike, around a hub and around a common passage."""
    r = random.Random(11)
    vocab = ["v%d" % i for i in range(4000)]
    base = [r.choice(vocab) for _ in range(150)]
    rows = [(1, " ".join(base))]
    for i in range(2, 180):
        words = list(base) if i % 4 else rows[r.randrange(len(rows))][1].split()
        for _ in range(r.choice([1, 2, 3, 4, 6, 9])):
            at = r.randrange(len(words))
            words[at:at + r.choice([0, 1, 1, 2])] = [r.choice(vocab)]
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:60] + [r.choice(vocab) for _ in range(r.choice([4, 8, 40]))])) for i in range(40)]
    s = {i: x for i, x in sets(rows).items()}
    comp = {i: i for i in s}
    for a in s:
        for b in s:
            if a < b and comp[a] != comp[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                low, high = sorted((comp[a], comp[b]))
                comp = {k: low if v == high else v for k, v in comp.items()}
    assert len(set(comp.values())) > 20 and max(list(comp.values()).count(v) for v in set(comp.values())) > 40
    assert {x.doc_id: x.component_id for x in ngram_join.near_classes(make(rows)).collect()} == comp


def test_ngram_join_empty_and_null_ids(make):
    assert ngram_join.near_classes(make([])).collect() == []
    got = ngram_join.near_classes(make([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (9, "A b c d e f")])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got if r.doc_id) == [(5, 5), (5, 5), (9, 5)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_index_finds_every_similar_pair():
    r = np.random.default_rng(1)
    for size in (5, 8, 13, 30, 70, 300, 900):
        for _ in range(20):
            a = np.unique(r.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
            most = len(a) // 9
            b = np.unique(np.concatenate([a[most:] if r.random() < .5 else a[:len(a) - most], r.integers(0, 1 << 63, r.integers(0, most + 1)).astype(np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
                continue
            keys, row, *_ = ngram_join.index_keys(np.concatenate([a, b]), np.array([len(a), len(b)]))
            assert np.intersect1d(keys[row == 0], keys[row == 1]).size or np.array_equal(a, b)


def test_span_removal(make):
    rows = sample(5)
    words = {i: WORD.findall((t or "").encode()) for i, t in rows}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][j:j + 13]), i)
    want = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j:j + 13])] < i:
                gone[j:j + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in span_dedup.remove_repeats(make(rows)).collect()}
    assert got == want
    assert span_dedup.remove_repeats(make([])).collect() == []


def test_simhash(make):
    rows = sample(7)
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), len(x[1]), hashlib.md5(x[1].encode()).hexdigest()))
    got = simhash.edited_fingerprints(make(rows)).collect()
    prints = {}
    for r in got:
        prints.setdefault(r.n_chars, set()).add(r.fingerprint)
    want = []
    for k, (i, t) in enumerate(order):
        half = len(t) // 2
        edited = t[:len(t) - half] + order[(k + 1) % len(order)][1][:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        for digest, value in ((r.edited_sha256, r.edited_fingerprint),):
            assert by_text.setdefault(digest, value) == value
    single = {i: t or "" for i, t in rows if [x for x, _ in rows].count(i) == 1}
    alike = {}
    for r in got:
        if r.doc_id in single:
            assert alike.setdefault(single[r.doc_id], r.fingerprint) == r.fingerprint
    # likeness from the fingerprints themselves
    full = 64 * simhash.WORDS
    for r in got:
        a, b = r.fingerprint, r.edited_fingerprint
        near = 1.0 if not a and not b else 0.0 if not a or not b else max(0.0, float(np.cos(bin(int(a, 16) ^ int(b, 16)).count("1") * np.pi / full)))
        assert r.near_edited == pytest.approx(near, abs=1e-9)
    assert simhash.edited_fingerprints(make([])).collect() == []
    assert [(r.n_chars, r.near_next) for r in simhash.edited_fingerprints(make([(1, "only one")])).collect()] == [(8, 1.0)]


def test_simhash_radius(spark):
    r = np.random.default_rng(2)
    base = r.integers(-2**63, 2**63 - 1, (40, 2))
    rows = []
    for i in range(120):
        f = [int(x) for x in base[i % 40]]
        for b in r.integers(0, 128, i % 5):
            v = (f[b // 64] & (2**64 - 1)) ^ (1 << int(b % 64))
            f[b // 64] = v - 2**64 if v >= 2**63 else v
        rows.append((i, tuple(f)))
    names = {}
    for i, f in rows:
        names.setdefault(f, i)
    want = {(a, b) for f, a in names.items() for g, b in names.items() if a < b and sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(f, g)) <= 3}
    df = spark.createDataFrame(rows, "doc_id long, f struct<f0:long,f1:long>")
    assert {(r.a, r.b) for r in simhash.within_radius(df, radius=3).collect()} == want


def test_packing(make):
    from tokenizers import Tokenizer
    rows = sample(9) + [(200000, "<|endoftext|> x"), (200001, "日本 é \U0001F600 don't 12345")]
    tok = Tokenizer.from_file(vocabulary()[0])
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    got = packing.pack(make(rows), *vocabulary()).collect()
    at, seqs = {}, {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        piece = ids[r.doc_id][r.start:r.start + r.length]
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32
        at[r.doc_id] = r.start + r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {i: len(x) for i, x in ids.items()}
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048


def test_mixing(make):
    rows = sample(11, 400)
    got = mixing.mix(make(rows)).collect()
    size = {i: len(WORD.findall((t or "").encode())) for i, t in rows}
    assert {r.doc_id: r.size for r in got} == size
    targets = {(r.source_size, r.target) for r in got}
    assert sum(t for _, t in targets) == pytest.approx(sum(size.values()))
    assert all(t <= 3 * s + 1e-6 for s, t in targets) and all(r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0 for r in got)
    again = mixing.mix(make(rows).repartition(5)).collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in again}
    assert mixing.mix(make([])).collect() == []


def test_embeddings(spark):
    df = spark.read.parquet(f"{SMOKE}/embeddings.parquet")
    rows = [tuple(r) for r in df.collect()]
    nan = float("nan")
    rows += [(90001, None, 1), (90002, [0.0] * 64, 1), (90003, [nan] * 64, 1), (90004, rows[0][1], None), (90005, rows[0][1], rows[0][2])]
    got = {r.vec_id: r for r in ann.near_duplicates(spark.createDataFrame(rows, df.schema)).collect()}
    good = [r for r in rows if r[0] < 90001 or r[0] == 90005]
    v = np.array([r[1] for r in good], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    labels = np.array([r[2] for r in good])
    true = ((v @ v.T >= 0.93) & (labels[:, None] == labels[None, :])).sum(1) - 1
    found = np.array([got[r[0]].n_links for r in good])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum()
    assert got[90005].component_id <= rows[0][0] and all(got[i].n_links == 0 and got[i].component_id == i for i in range(90001, 90005))


def test_embeddings_of_dense_groups(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_MOST", 1000)
    rng = np.random.default_rng(3)
    at = lambda n, spread: rng.normal(size=64) / 8 + spread * rng.normal(size=(n, 64))
    groups = [np.concatenate([at(2300, 0.028), rng.normal(size=(300, 64))]), at(2400, 0.012), rng.normal(size=(50, 64))]
    v = np.concatenate(groups)
    labels = np.repeat(np.arange(3), [len(g) for g in groups])
    df = spark.createDataFrame([(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(v, labels))], "vec_id long, embedding array<double>, label long")
    got = {r.vec_id: r for r in ann.near_duplicates(df.repartition(8)).collect()}
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    hit = (v @ v.T >= 0.93) & (labels[:, None] == labels[None, :])
    assert [got[i].n_links for i in range(len(v))] == (hit.sum(1) - 1).tolist()
    least = np.arange(len(v))
    for _ in range(20):
        least = np.array([least[h].min() for h in hit])
    assert [got[i].component_id for i in range(len(v))] == least.tolist()


def test_embeddings_by_the_graph_alone(spark, monkeypatch):
    """Clusters of a few to some hundred vectors, no group counted exactly: nearly all links, none that isn't there."""
    monkeypatch.setattr(ann, "exact_links", None)
    rng = np.random.default_rng(6)
    groups = []
    for size in (1, 2, 3, 40, 300, 1800):
        parts = [rng.normal(size=64) / 8 + 0.024 * rng.normal(size=(n, 64)) for n in rng.integers(1, 60, max(1, size // 20))]
        groups.append(np.concatenate(parts)[:size])
    v = np.concatenate(groups)
    labels = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    df = spark.createDataFrame([(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(v, labels))], "vec_id long, embedding array<double>, label long")
    got = {r.vec_id: r for r in ann.near_duplicates(df.repartition(8)).collect()}
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    true = ((v @ v.T >= 0.93) & (labels[:, None] == labels[None, :])).sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(v))])
    assert true.sum() > 10_000 and (found <= true).all() and found.sum() >= 0.95 * true.sum()


def test_embeddings_without_rows(spark):
    assert ann.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label long")).collect() == []


def test_pii(make):
    text = "mail a.b@c-d.org, ip 10.0.0.255 not 10.0.0.256 card 4111 1111 1111 1111 call +1 (555) 010-9999."
    rows = [(1, text), (2, None), (3, ""), (4, "nothing here"), (5, "É " * 5 + "x@y.zz"), (5, "a@b@c.d")]
    got = pii.find(make(rows)).collect()
    r = next(r for r in got if r.doc_id == 1)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    base = [(m.start(), k, m.end()) for k, p in ((0, r"a\.b@c-d\.org"), (1, r"10\.0\.0\.255"), (2, "4111[ 1]*1"), (3, r"\+1.*9999")) for m in re.finditer(p, text)]
    assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
    empty = hashlib.sha256(b"").hexdigest()
    assert all(x.base_sha256 == empty and x.spans == "" for x in got if x.doc_id in (2, 3, 4))
    assert {x.spans for x in got if x.doc_id == 5} == {"email:10:16", "email:2:7"}


def test_pii_repeats_are_consistent():
    weights = np.zeros((pii.FEATURES, pii.N))
    pull = np.zeros((2, pii.N, pii.N))
    pull[1] = 4 * np.eye(pii.N)
    text = "pay 4111111111111111 again 41111111111111110"
    assert pii.added_spans(text, pii.base_spans(text), weights, pull) == [(27, 2, 44)]


def test_html(spark):
    page = ("<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>menu</a></nav><div class=\"ad\">buy</div>"
            "<article><h1>Head</h1><p>One  &amp;\n two<br>three<p><b>bold</b>er</p></article><div class='comments'><p>no</p></div><footer>f</footer>")
    rows = [(i, f"http://h.example/{i}", page.replace("One", f"One{i}"), 1) for i in range(4)] + [(9, None, None, 1), (10, "odd", "", 1), (11, "http://z/", "plain <b>text</b>", 1)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host long").drop("host")).collect()}
    assert got == {**{i: f"Head One{i} & two three bolder" for i in range(4)}, 9: "", 10: "", 11: "plain text"}


def test_html_vectors_tell_counts_of_pages_apart(spark):
    rows = [(1, "h", "<div class=a></div><div class=a></div><div class=b></div>"), (2, "h", "<div class=a></div><div class=b></div><div class=b></div>")]
    got = html_extract.occurrences(spark.createDataFrame(rows, "page_id long, host string, html string")).collect()
    assert len(got) == 2 and len({r.vector for r in got}) == 2 and {r.pages for r in got} == {2}


def test_html_attributes(spark):
    page = ("<html><body class='single no-sidebar'><div class=ad>buy</div><article><div class='article-header'><h1>Head</h1></div>"
            "<p title='a hidden gem'>one <a href=\"/hidden-valley\">two</a> <a href=/x?id=search>three</a> <i aria-hidden=\"false\">four</i></p>"
            "<p hidden>no</p><p style='color:red; display: none'>no</p><p class='x share'>no</p><p id=comments>no</p></article></body></html>")
    rows = [(1, "http://h.example/1", page), (2, "http://g.example/", "<body class='menu'><main class='header'><p data-id='menu'>text</p></main>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Head one two three four", 2: "text"}


def test_html_broken_pages(spark):
    pages = {"<article><p don't>one</p><p>two</p></article>": "one two", "<article>super<wbr>man <img src=x>x</article>": "superman x",
             "<article><p>a</p><button>x<p>b</p></article>": "a x b", "<article><p>a</p><svg><p>b</p></article>": "a b", "<article>a<svg/>b</article>": "a b",
             "<head><title>T<body><article><p>x</p></article>": "x", "<title>T": "", "<article><a title='x>y' href=\"q'\">ok</a></article>": "ok",
             "<article><p>a</p><script>b": "a", "<article>a < b <p>c": "a < b c", "<article><p a=\"": "", "<": "<", "": ""}
    rows = [(i, f"http://h{i}.example/", p) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(pages.values()))
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string, text string, template binary")).count() == 0


def test_html_classes_are_ordered_and_nest(spark):
    tokens = lambda text: [ord(c) for c in text]
    classes = lambda **cs: ({ord(t): (i, p) for i, (c, p) in enumerate(cs.values()) for t in c}, {i: len(c) for i, (c, _) in enumerate(cs.values())})
    of, size = classes(x=("abc", 3))
    assert sorted(html_extract.places(tokens("abcabc"), of, size)) == [(97, 0, 0), (98, 1, 1), (99, 2, 2)]
    assert sorted(html_extract.places(tokens("abcacb"), of, size)) == [(97, 0, 0), (98, 1, 2), (99, 1, 2)]
    of, size = classes(x=("abc", 5), y=("pq", 4))
    for text, lost in (("apqbc", []), ("apqbpqc", []), ("pabcq", []), ("abcpq", []), ("apbqc", [1]), ("pabqc", [1]), ("abcabpcq", [1])):
        assert [c for c, _, _ in html_extract.crossings(tokens(text), of, size)] == lost
    # two blocks that change places on one of three pages are no template; those that keep theirs are
    top, one, two, end = "<div class=t>top</div>", "<div class=u>one</div>", "<div class=v>two</div>", "<div class=w>end</div>"
    rows = [(i, f"http://h.example/{i}", "<body>" + top + (two + one if i == 1 else one + two) + f"<p>page {i}</p>" + end) for i in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "one two page 0", 1: "two one page 1", 2: "one two page 2"}


def test_html_article_text_takes_part_in_classes(spark):
    rows = [(i, "h", f"<article><p>same</p><p>own {i}</p></article>") for i in range(3)]
    got = html_extract.occurrences(spark.createDataFrame(rows, "page_id long, host string, html string")).collect()
    assert sorted((r.is_text, r.pages) for r in got) == [(False, 3), (False, 3), *[(True, 1)] * 3, (True, 3)]
    # "top" and the article's "same" recur alike but change places, so neither is template; "end" keeps its place
    top, same, end = "<div class=t>top</div>", "<article><p>same</p></article>", "<div class=w>end</div>"
    rows = [(i, f"http://h.example/{i}", "<body>" + (same + top if i == 1 else top + same) + end) for i in range(3)]
    pages = html_extract.parsed(spark.createDataFrame(rows, "page_id long, host string, html string").withColumn("host", F.lit("h")))
    template = html_extract.templates(html_extract.occurrences(pages), pages).collect()[0].template
    text = lambda block: -1 - next(html_extract.key(e) for e in html_extract.parse(rows[0][2]) if e[0] == "text" and e[4] == block)
    assert text("end") in template and text("top") not in template and text("same") not in template
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict.fromkeys(range(3), "same")


def test_html_deep_pages():
    import tracemalloc
    tracemalloc.start()
    assert sum(e[0] == "open" for e in html_extract.parse("<div>" * 100_000 + "x" + "</p>" * 1000)) == 100_000
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all((zlib.crc32(str(i).encode()) % 4 == 2) == r.held_out for i, r in got.items())
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) >= 0.95


def test_rollup(make):
    rows = [(3, "Ab c1 x@y.zz"), (1, "same text"), (2, "same text"), (4, None), (5, "")]
    got = {(r.source, r.version): (r.docs, r.tokens) for r in rollup.maintained(make(rows)).collect()}
    assert sum(d for (_, v), (d, _) in got.items() if v == "words-1") == 3
    assert sum(t for (_, v), (_, t) in got.items() if v == "words-1") == 2 + 2
    assert rollup.maintained(make([])).collect() == []


def test_rollup_judges_rows_by_text_and_id(make):
    """A copy stays out though its doc_id names a unique text too; a text of a null doc_id alone stays; nulls lose to ids."""
    rows = [(1, "one two"), (2, "one two"), (2, "unique words here"), (None, "no id"), (None, "one two"), (7, "again a b"), (7, "again a b")]
    got = rollup.maintained(make(rows)).where("version = 'words-1'").collect()
    assert sum(r.docs for r in got) == 1 + 1 + 1 + 2 and sum(r.tokens for r in got) == 2 + 3 + 2 + 6


def test_rollup_commits_are_published_whole(make, spark):
    store = rollup.new_store(spark)
    one, two = make([(1, "a b c")]), make([(1, "a b c d e")])
    tokens = lambda: {r.version: r.tokens for r in rollup.totals(spark, store).collect()}["words-1"]
    rollup.commit(spark, store, "b", rollup.changes(one, 1))
    assert tokens() == 3
    # an attempt that wrote its rows and died before it was published changes nothing
    rollup.changes(two, 1).groupBy(*rollup.KEYS).sum("docs", "tokens").toDF(*rollup.KEYS, "docs", "tokens").write.parquet(f"{store}/data/attempt=a-dead")
    assert tokens() == 3
    rollup.commit(spark, store, "b", rollup.changes(two, 1))
    assert tokens() == 5
    rollup.commit(spark, store, "c", rollup.changes(one, -1))
    assert tokens() == 2


def test_masks_cover_overlapping_spans(make):
    import corpus_pipeline
    texts = ["root@10.0.0.1", "4111111111111111@mail.com", "+49.30.12.34.567", "a root@10.0.0.1 b 10.0.0.2 c", "none", None]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.mask_personal_data(None, make(list(enumerate(texts))), None).collect()}
    assert [got[i][0] for i in range(6)] == ["<EMAIL>", "<EMAIL>", "<PHONE>", "a <EMAIL> b <IP> c", "none", None]
    assert [got[i][1] for i in range(5)] == [7, 7, 7, 18, 4]


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    before = None
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMOKE)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        n = docs.count()
        assert n > 0 and (before is None or name in ("mixing", "packing") or n <= before)
        before = n


def stage_rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_near_duplicates_by_row(spark, make):
    import corpus_pipeline as P
    r = random.Random(11)
    words = lambda n: " ".join("w%d" % r.randrange(10_000) for _ in range(n))
    t, u, v = words(60), words(60), words(60)
    near = " ".join(t.split()[:-1] + ["other"])
    rows = [(1, t), (1, t), (2, u), (2, t), (3, near), (None, v), (None, v), (None, t), (4, None), (4, None), (5, ""), (None, " ")]
    kept = stage_rows(P.near_duplicates(spark, make(rows), SMOKE))
    assert kept == sorted([(1, t), (2, u), (None, v), (4, None), (4, None), (5, ""), (None, " ")], key=repr)
    many = [(i % 3, t) for i in range(300)] + [(9, near)] * 50
    assert stage_rows(P.near_duplicates(spark, make(many), SMOKE)) == [(0, t)]


def test_mix_sources_by_row(spark, make):
    import corpus_pipeline as P
    rows = [(1, "a " * 40), (1, "b " * 500), (None, "c " * 30), (None, "d " * 70), (3, None), (4, "")] + [(10 + i, "x y z " * (i % 7 + 1)) for i in range(120)]
    docs = make(rows)
    size = lambda x: len((x or "").split())
    made = stage_rows(P.mix_sources(spark, docs, SMOKE))
    assert {x for x in rows if not size(x[1])} == {x for x in made if not size(x[1])}
    assert all(made.count(x) <= 3 for x in set(made))
    taken, want = {}, {}
    source = {x: f"src{n % 3}" if n % 5 else None for n, x in enumerate(rows)}
    for x in made:
        taken[source[x]] = taken.get(source[x], 0) + size(x[1])
    for m in mixing.mix(docs).select("source_size", "target").distinct().collect():
        want[m.source_size] = m.target
    totals = {}
    for x in rows:
        totals[source[x]] = totals.get(source[x], 0) + size(x[1])
    for s, total in totals.items():
        assert abs(taken.get(s, 0) - want[total]) <= max(size(x[1]) for x in rows if source[x] == s)


def test_stages_of_empty_tables(spark, make):
    import corpus_pipeline as P
    docs = make([(1, "a")]).where("doc_id > 1")
    for name, stage in P.STAGES:
        assert stage(spark, docs, SMOKE).count() == 0, name
