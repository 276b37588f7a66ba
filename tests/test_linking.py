"""Nearest vectors, similar records, outliers, lookups, headers and keys against plain Python on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablefold.operators import clean as CL
from tablefold.operators import discover as DV
from tablefold.operators import nearest as NV
from tablefold.operators import outliers as OL
from tablefold.operators import similar as SM
from tablefold.operators import transform as TR
from tablefold.operators.components import components


def _vectors(spark, m, start=0):
    return spark.createDataFrame([(start + i, x.tolist()) for i, x in enumerate(m)], "id long, v array<double>")


def test_nearest_recall_where_buckets_decide(spark, monkeypatch):
    monkeypatch.setattr(NV, "TARGET", 4)                       # 10 bits: a bucket holds a few of 2,500 vectors
    rng = np.random.default_rng(3)
    right = rng.normal(size=(2500, 48))
    left = right[:1500] + 0.45 * rng.normal(size=(1500, 48))   # cosines of about 0.91
    got = {r.id: (r.partner, r.cosine) for r in NV.nearest_value_join(_vectors(spark, left), "id", "v", _vectors(spark, right, 10_000), "id", "v").collect()}
    u = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = u(left) @ u(right).T
    best = cos.argmax(1)
    want = {i: 10_000 + int(b) for i, b in enumerate(best) if cos[i, b] >= 0.8}
    assert len(got) == 1500 and len(want) > 1400
    assert sum(got[i][0] == p for i, p in want.items()) >= 0.99 * len(want)
    assert all(p is None or c >= 0.8 for p, c in got.values())


def test_nearest_hot_bucket_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(NV, "BLOCK", 16)
    nan = float("nan")
    rows = [(i, [1.0, 0.0, 0.1]) for i in range(100)] + [(200, None), (201, [0.0] * 3), (202, [nan, 1.0, 1.0]), (203, [1.0, None, 1.0]), (204, [-1.0, 0.0, 0.0]), (204, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    right = df.where("id BETWEEN 40 AND 203")
    got = {r.id: r.partner for r in NV.nearest_value_join(df, "id", "v", right, "id", "v").collect()}
    assert all(got[i] == 40 for i in range(100)) and all(got[i] is None for i in range(200, 205)) and len(got) == 105
    assert NV.nearest_value_join(df, "id", "v", df.where("false"), "id", "v").where("partner IS NOT NULL").count() == 0


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_records_equal_all_pairs(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, r.choice(["x", None]), " ".join(r.choice(words[:40 if i % 2 else 60]) for _ in range(r.choice([1, 2, 3, 5, 9, 20])))) for i in range(150)]
    for i in range(150, 320):
        _, b, t = rows[r.randrange(150)]
        t = t.split()
        t[r.randrange(len(t))] = r.choice(words)
        rows.append((i, b, "  ".join(t).upper() if i % 2 else " ".join(t)))
    rows += [(400, "x", None), (401, "x", "  "), (402, None, "")]
    sets = {i: (b, frozenset((t or "").lower().split())) for i, b, t in rows}
    comp = {i: i for i in sets}
    links = {i: set() for i in sets}
    for i, (b, s) in sets.items():
        for j, (c, t) in sets.items():
            if i != j and b == c and s and t and len(s & t) / len(s | t) >= 0.7 - 1e-12:
                if s != t:
                    links[i].add(t)
                lo, hi = sorted((comp[i], comp[j]))
                comp = {k: lo if v == hi else v for k, v in comp.items()}
    got = {x.id: x for x in SM.entity_match_similar(spark.createDataFrame(rows, "id long, block string, t string"), "id", ["block"], ["t"], 0.7).collect()}
    assert {i: x.cluster_id for i, x in got.items()} == comp
    assert {i: x.n_links for i, x in got.items()} == {i: len(x) for i, x in links.items()}
    assert all(x.cluster_size == list(comp.values()).count(x.cluster_id) for x in got.values())


@pytest.mark.parametrize("few", [5, 20_000])
def test_exact_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(OL, "FEW", few)
    monkeypatch.setattr(OL, "ACCURACY", 100)
    r = random.Random(2)
    for values in ([r.gauss(0, 1) for _ in range(4000)], [1.0] * 3000 + [2.0, 3.0], [float(r.randrange(9)) for _ in range(3001)], [7.5], [2.0, 1.0]):
        df = spark.createDataFrame([(x,) for x in values] + [(None,), (float("nan"),)], "x double").repartition(5)
        for q in (0.5, 0.25, 1.0):
            assert OL.exact_quantile(df, F.col("x"), q) == sorted(values)[max(1, -int(-q * len(values) // 1)) - 1]
    assert OL.exact_quantile(df.where("false"), F.col("x"), 0.5) is None


def test_outliers_without_spread_or_rows(spark):
    df = spark.createDataFrame([(i, 5.0, "AB-12") for i in range(90)] + [(90, 6.0, "ab 12"), (91, None, None), (92, float("nan"), "")], "id long, x double, s string")
    assert [(r.id, r.z) for r in OL.numeric_outliers(df, ["id"], "x").collect()] == [(90, None)]
    assert sorted(r.id for r in OL.pattern_outliers(df, ["id"], "s").collect()) == [90, 92]
    assert OL.numeric_outliers(df.where("false"), ["id"], "x").count() == 0 and OL.pattern_outliers(df.where("false"), ["id"], "s").count() == 0


def test_lookup_without_any_entry_falls_back(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "y"), (4, "a", None), (5, "b", " "), (6, None, ""), (7, "c", None)], "id long, k string, v string")
    got = {r.id: (r.imputed, r.source) for r in CL.impute_lookup(df, "id", "v", ["k"]).collect()}
    assert got == {4: ("x", "k"), 5: ("x", "mode"), 6: ("x", "mode"), 7: ("x", "mode")}       # b has one row only
    assert {r.imputed for r in CL.impute_lookup(df.where("v IS NULL"), "id", "v", ["k"]).collect()} == {None}


def test_headers_are_matched_once(spark):
    u = spark.createDataFrame([("t", i, v) for i, vs in enumerate([["1", "2"], ["1", "2", "3"], ["x"], [None]]) for v in vs], "case_id string, col_idx int, value string")
    k = spark.createDataFrame([("t", h, v) for h, vs in {"n": ["1", "2", "3"], "s": ["x", "y"]}.items() for v in vs], "case_id string, header string, value string")
    got = {r.col_idx: r.header for r in TR.match_headers(TR.header_scores(u, k)).collect()}
    assert got == {0: None, 1: "n", 2: "s"}


def test_header_profiles_scan_values_twice(spark):
    """Shapes, types and counts of the values come from one pass, the common values from another."""
    u = spark.createDataFrame([("t", 0, "a1"), ("t", 0, "a1"), ("t", 0, "7"), ("t", 1, None)], "case_id string, col_idx int, value string")
    values, shapes, distinct = TR._profiles(u, "col_idx")
    assert sorted(map(tuple, shapes.collect())) == [("t", 0, "9", 1 / 3), ("t", 0, "a9", 2 / 3)]
    assert [(r.n_distinct, r.kind) for r in distinct.collect()] == [(2, "text")] and values.count() == 2
    assert "regexp_replace" not in shapes._jdf.queryExecution().optimizedPlan().toString() + distinct._jdf.queryExecution().optimizedPlan().toString()


def test_keys_of_mixed_types_and_nulls(spark):
    a = spark.createDataFrame([(1, "p", 1.5), (2, "q", 2.0), (3, None, None)], "a_id int, a_name string, a_x double")
    b = spark.createDataFrame([(1, "p", 2.0), (1, "p", 2.0), (None, None, float("nan"))], "b_id bigint, b_name string, b_x double")
    got = {(r.fk_table, r.fk_column, r.pk_table, r.n_hits, r.containment) for r in DV.key_foreign_keys({"a": a, "b": b}, 0.0).collect()}
    assert got == {("b", "b_id", "a", 1, 1.0)}                                                # names and x hold NULL: no key
    assert DV.key_foreign_keys({"a": a}, 0.0).count() == 0


def test_similar_records_compare_few_pairs(spark, monkeypatch):
    """Texts of one vocabulary: only pairs that pass all filters are compared in full; any order of tokens gives the same."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, "x" if i % 2 else None, " ".join(r.sample(words, 20))) for i in range(300)]
    rows += [(300 + i, b, t + " more") for i, b, t in rows[:20]] + [(None, "x", "p q r s t"), (401, "x", "p q r s t u"), (5, "x", rows[5][2])]
    df = spark.createDataFrame(rows, "id long, block string, t string")
    want = {(i, 300 + i) for i in range(20)}
    whole = SM.materialize
    for counted in (50_000, 10):
        monkeypatch.setattr(SM, "COUNTED_SETS", counted)
        monkeypatch.setattr(SM, "CELL_SETS", 1024 if counted > 10 else 2)
        seen = []
        monkeypatch.setattr(SM, "materialize", lambda d: seen.append(whole(d)) or seen[-1])
        got = {x.id: x for x in SM.entity_match_similar(df, "id", ["block"], ["t"], 0.9).collect()}
        assert {(x.cluster_id, x.id) for x in got.values() if x.cluster_id != x.id} == want
        assert {i for i, x in got.items() if x.n_links} == {i for p in want for i in p} and None not in got
        sizes = [d.count() for d in seen if d.columns == ["a", "b"]]
        assert sizes[-1] == 20 and sizes[-2] <= 60        # compared, of 45,000 pairs that share a word


def test_similar_records_of_long_texts(spark, monkeypatch):
    """Long texts about the threshold equal all pairs; texts that share some rare words by chance are no candidates, and tokens of sets without one stay where they are."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    sets = [set(r.sample(words, n)) for n in (300, 420, 600) for _ in range(40)]
    for base in sets[::6]:
        for share in (0.03, 0.1, 0.12, 0.2, 0.24):            # left out, or replaced by others
            k = int(len(base) * share)
            less = base - set(r.sample(sorted(base), k))
            sets += [less, less | set(r.sample(words, k))]
    links = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    whole, seen = SM.materialize, []
    monkeypatch.setattr(SM, "materialize", lambda d: seen.append(whole(d)) or seen[-1])
    df = spark.createDataFrame([(i, " ".join(sorted(x))) for i, x in enumerate(sets)], "id long, t string")
    got = {x.id: x.n_links for x in SM.entity_match_similar(df, "id", [], ["t"], 0.8).collect()}
    assert got == dict(enumerate(links)) and 100 < sum(links) // 2 < 1000
    first = next(d for d in seen if d.columns == ["a", "b"])
    assert first.count() < 1500                               # of 51,040 pairs; 1,100 are of one text's copies
    names = spark.createDataFrame([(x, [x]) for x in (-2**63, -65, -1, 5, 63, 64, 2**62)], "set long, tokens array<long>")
    assert sorted(x.set for x in SM._paired(names, spark.createDataFrame([(-65, 63), (-2**63, 2**62)], "a long, b long")).collect()) == [-2**63, -65, 63, 2**62]
    assert SM._paired(names, spark.createDataFrame([], "a long, b long")).count() == 0
