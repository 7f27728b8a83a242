"""Hand-computed cases, quirks and invariants of the reference operators."""

import hashlib
import tracemalloc
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from allelic.fixtures import load
from allelic.functions import scalars as fn
from allelic.operators import blocks, bootstrap, contexts, evaluate, filters, genome, impact, inference, intervals, scoring, stratify, tracks
from allelic.plans import core, genome_queries, registry
from allelic.plans.queries import full_queries
from allelic.sources import readers, scratch, sinks


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


GWAS = "variant_id long, locus_id long, chromosome string, position long, ref string, alt string, allele_freq double, p_value double"


def gwas(spark, data):
    return spark.createDataFrame([(i, 1, "chr1", pos, ref, alt, af, p) for i, (pos, ref, alt, af, p) in enumerate(data)], GWAS)


def test_labels_by_hand(spark):
    df = gwas(spark, [
        (10, "A", "C", 0.3, 1e-9), (20, "A", "C", 0.01, 1e-8), (15, "A", "C", 0.99, 0.5), (30, "A", "C", 0.02, 0.5),
        (12, "A", "C", 0.5, 0.5), (13, "AT", "C", 0.5, 0.5), (14, "A", "C", 0.05, 0.5), (16, "A", "C", 0.5, 1e-5),
    ])
    cuts = stratify.Cuts(min_bg=2)
    got = rows(stratify.stratify(df, cuts), "variant_id", "var_label")
    # A significant rare variant comes twice; frequency at the cut is neither rare nor common;
    # a rare one outside the candidates' range is other; indels go.
    assert got == sorted([(0, "candidate"), (1, "candidate"), (1, "rare"), (2, "rare"), (3, "other"), (4, "background"), (6, "other"), (7, "other")], key=repr)
    first = rows(stratify.stratify(df, cuts, overlap="first"), "variant_id", "var_label")
    assert (1, "candidate") in first and (1, "rare") not in first and len(first) == 7


def test_fallbacks(spark):
    df = gwas(spark, [(i, "A", "C", 0.3 + i / 100, 0.1 + i / 10) for i in range(6)])
    got = rows(stratify.stratify(df, stratify.Cuts(n_top=2, min_bg=3)), "variant_id", "var_label")
    assert [v for v, x in got if x == "candidate"] == [0, 1]
    short = rows(stratify.stratify(df, stratify.Cuts(n_top=2, min_bg=100)), "variant_id", "var_label")
    assert sum(x == "background" for _, x in short) == 6
    few = stratify.mark_background(stratify.mark_rare(stratify.mark_candidates(df)), stratify.Cuts(min_bg=7, af_cut=0.33))
    assert sum(r.is_background for r in few.collect()) == 6
    counted = gwas(spark, [(1, "AT", "C", 0.9, 0.5), (2, "A", "C", 0.01, 0.5), (3, "A", "C", 0.02, 0.5)])
    top = stratify.mark_background(counted.withColumn("is_rare", F.lit(False)), stratify.Cuts(min_bg=2))
    assert [r.variant_id for r in top.filter("is_background").collect()] == [0, 2]  # an indel takes a place before it goes


def test_labels_cover_all_snvs_for_any_partitioning(spark, sf_dir):
    df = load(spark, sf_dir, "fx_gwas")
    want = rows(stratify.stratify(df), "variant_id", "var_label")
    assert {v for v, _ in want} == {r.variant_id for r in filters.snv_only(df).collect()}
    for n in (1, 13):
        assert rows(stratify.stratify(df.repartition(n)), "variant_id", "var_label") == want


def test_normal_quantile(spark):
    ps = [1e-12, 1e-6, 0.01, 0.07, 0.08, 0.3, 0.5, 0.6, 0.95, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select(F.expr(fn.normal_quantile_sql("p")).alias("x"))
    for p, r in zip(ps, df.collect()):
        assert abs(r.x - NormalDist().inv_cdf(p)) < 1e-6 * max(1, abs(r.x))


def test_draws_agree_with_plain_integers():
    def mix(x):
        x = ((x ^ x >> 16) * bootstrap.MIX_1) & bootstrap.MASK
        x = ((x ^ x >> 15) * bootstrap.MIX_2) & bootstrap.MASK
        return x ^ x >> 15

    def draw(boot, i, n, context, locus, seed):
        key = 0
        for v in (seed, context, locus):
            key = mix(mix(key ^ v & bootstrap.MASK) ^ (v >> 32) & bootstrap.MASK)
        return mix((mix(key ^ boot) + i * bootstrap.STEP) & bootstrap.MASK) * n >> 32

    for n, context, locus, seed in ((1, 0, 0, 0), (100, 3, 11, 0), (777, 2**40 + 5, -9, 4)):
        got = bootstrap.draws(np.arange(50), n, context, locus, seed)
        assert got.tolist() == [[draw(b, i, n, context, locus, seed) for i in range(n)] for b in range(50)]


def test_draws_are_even():
    counts = np.bincount(np.concatenate([bootstrap.draws(np.arange(2000), 97, c, 5).ravel() for c in range(5)]).astype(int), minlength=97)
    expected = counts.sum() / 97
    assert ((counts - expected) ** 2 / expected).sum() < 150  # 96 degrees of freedom


def labelled(spark, background, others):
    data = [(i, 1, "background", 0, "x", e) for i, e in enumerate(background)] + [(100 + i, 1, "candidate", 0, "x", e) for i, e in enumerate(others)]
    return spark.createDataFrame(data, "variant_id long, locus_id long, var_label string, context_id long, context string, effect double")


def test_tasks_of_labels_follow_the_rows(spark, monkeypatch):
    data = load(spark, "/root/testdata/sf0.001", "fx_gwas")
    expected = rows(stratify.stratify(data), "variant_id", "var_label")
    assert stratify.row_tasks(data) is None
    monkeypatch.setattr(stratify, "ROWS", 20)
    tasks = stratify.row_tasks(data)
    assert tasks == -(-data.count() // 20) > spark.sparkContext.defaultParallelism
    assert rows(stratify.stratify(data), "variant_id", "var_label") == expected
    # No window of the plan takes more rows in a task than the limit allows on average.
    plan = stratify.stratify(data)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count(f", {tasks})") + plan.count(f", {tasks}, ") >= 4


def test_only_loci_that_lack_something_are_ranked(spark):
    """Where every locus has a significant variant and enough background, no row is sorted or dealt by locus."""
    schema = "variant_id long, locus_id long, position long, ref string, alt string, allele_freq double, p_value double"
    data = [(i, i % 3, i, "A", "C", 0.3, 1e-9 if i < 3 else 0.5) for i in range(60)]
    cuts = stratify.Cuts(min_bg=10)
    plain, lacking = (spark.createDataFrame(d, schema) for d in (data, [*data, *((100 + i, 9, i, "A", "C", 0.3, 0.01 * i) for i in range(1, 16))]))
    found, want = stratify.stratify(plain, cuts), [(i, "candidate" if i < 3 else "background") for i in range(60)]
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text and "Aggregate" not in text and set(rows(found, "variant_id", "var_label")) == set(want)
    found = stratify.stratify(lacking, cuts)
    assert "Window" in found._jdf.queryExecution().optimizedPlan().toString()
    more = rows(found, "variant_id", "var_label")
    # Candidates by rank; of background there is enough.
    assert len(more) == 85 and set(more) == {*want, *((101 + i, "candidate") for i in range(10)), *((101 + i, "background") for i in range(15))}


def test_background_is_read_from_stored_files(spark):
    from allelic.sources.scratch import stored

    data = [(v, v % 4, ("background", "rare", None)[v % 3], c, None if v % 7 == 0 else (v * 13 + c) % 11 - 5.0) for v in range(300) for c in (0, 1)]
    data += [(1000, None, "background", 0, 1.0), (1001, 1, "background", None, 1.0)]
    table = stored(spark.createDataFrame(data, "variant_id long, locus_id long, var_label string, context_id long, effect double").repartition(5), "t")
    packed = bootstrap.packed_background(table)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "Range" in plan and "parquet" not in plan.lower()  # no row of effects goes to Python
    made = list(bootstrap.groups(packed.orderBy("locus_id", "context_id").toArrow().to_batches()))
    want = {}
    for v, locus, label, c, effect in data:
        if label == "background" and None not in (locus, c, effect):
            want.setdefault((locus, c), []).append(abs(effect))
    assert {(a, b): xs.tolist() for a, b, _, xs in made} == want
    assert rows(bootstrap.background_arrays(table, 5).groupBy("locus_id", "context_id").agg(F.sum("n").alias("n"))) == rows(bootstrap.background_arrays(table, 5, is_stored=True).groupBy("locus_id", "context_id").agg(F.sum("n").alias("n")))


def test_partitions_and_hot_groups_agree(spark):
    """Results do not depend on partitions, and a group dealt to several tasks counts as a whole one."""
    rng = np.random.default_rng(0)
    df = labelled(spark, rng.normal(0, 1, 60).tolist(), [0.0, None, 5.0, 2.2, 1.9, *rng.normal(0, 2, 80).tolist()])
    want = {r.boot: (r.boot_mean, r.boot_std) for r in bootstrap.bootstrap_null(df, 50).collect()}
    assert {r.boot: (r.boot_mean, r.boot_std) for r in bootstrap.bootstrap_null(df.repartition(8), 50).collect()} == want
    counts = [rows(bootstrap.count_nonsig(df.repartition(5), 50, group_rows=g), "variant_id", "n_nonsig") for g in (1 << 18, 20, 3)]
    assert counts[0] == counts[1] == counts[2] and len(counts[0]) == 145
    dealt = bootstrap.count_nonsig(df, 50, group_rows=20).withColumn("task", F.spark_partition_id())
    assert dealt.select("task").distinct().count() > 1


def test_only_effects_among_the_thresholds_are_dealt(spark, monkeypatch):
    rng = np.random.default_rng(4)
    bg = rng.normal(0, 1, 60).tolist()
    df = labelled(spark, bg, [0.0, None, 100.0, float("nan"), float("inf"), *np.linspace(1.5, 4.5, 31).tolist()])
    crit = bootstrap.critical_values(df).first().critical
    limits = sorted(r.boot_mean + crit * r.boot_std for r in bootstrap.bootstrap_null(df, 80).collect())
    held, plain = {}, bootstrap.stored
    monkeypatch.setattr(bootstrap, "stored", lambda made, name: held.setdefault(name, plain(made, name)))
    got = {r.variant_id: (r.effect, r.n_nonsig) for r in bootstrap.count_nonsig(df, 80).collect()}
    tested = {i: v for i, v in got.items() if i >= 60}
    assert len(got) == len(bg) + 36 and all(got[i][1] == 80 for i in range(60))
    for effect, n in tested.values():
        assert n == (None if effect is None else 80 - int(np.searchsorted(limits, abs(effect), "left")))
    among = sum(1 for e, _ in tested.values() if e is not None and limits[0] < abs(e) <= limits[-1])
    assert held["between"].count() == among and 0 < among < 31


def test_long_boots_of_two_loci_share_no_task(spark, monkeypatch):
    df = spark.range(40 * 30).selectExpr("id AS variant_id", "id % 40 AS locus_id", "'background' AS var_label", "id % 3 AS context_id", "id / 7.0 AS effect")
    monkeypatch.setattr(bootstrap, "locus_parts", lambda *_: 1)
    monkeypatch.setattr(bootstrap, "TASK_ROWS", 10)
    got = bootstrap.background_arrays(df, 30).withColumn("task", F.spark_partition_id())
    assert got.groupBy("task").agg(F.countDistinct("locus_id").alias("n")).filter("n > 1").count() == 0 and got.agg(F.sum("n")).first()[0] == 1200


def test_wide_lines_make_one_map_a_row(spark):
    from allelic.sources import sinks

    lines = sinks.matrix_lines(spark.createDataFrame([(1, "a", 1.5), (1, "c", None), (2, "b", 2.0)], "row_id long, context string, v double"), "v", columns=["c", "b", "a"])
    assert rows(lines, "row_id", "line") == [(1, "1\t\t\t1.5"), (2, "2\t\t2.0\t")]
    assert "lambdafunction(coalesce(map_from_entries" not in lines._jdf.queryExecution().optimizedPlan().toString()


def test_groups_without_background_or_keys(spark):
    data = [(1, 1, "candidate", 0, 5.0), (2, None, "candidate", 0, 1.0), (3, None, "background", 0, 1.0), (4, 1, "rare", None, None), (5, 1, None, 0, 1.0)]
    df = spark.createDataFrame(data, "variant_id long, locus_id long, var_label string, context_id long, effect double").withColumn("n", F.lit("clash")).withColumn("xs", F.lit("clash"))
    assert rows(bootstrap.count_nonsig(df, 10), "variant_id", "n_nonsig") == [(1, 10), (2, 10), (3, 10), (4, None), (5, 10)]
    assert bootstrap.count_nonsig(df.limit(0), 10).count() == 0


def test_bootstrap_pvalues(spark):
    rng = np.random.default_rng(1)
    bg = rng.normal(0, 1, 80).tolist()
    df = labelled(spark, bg, [0.1, 2.2, 9.0, -9.0, None])
    params = impact.Params(n_boots=200)
    got = {r.variant_id: r for r in impact.test_effects(df, params).collect()}
    assert got[102].n_nonsig == 0 and got[102].p_value == 1 / 201 and got[103].p_value == 1 / 201
    assert got[100].p_value == 1.0 and all(got[i].p_value == 1.0 for i in range(80))
    assert got[104].p_value is None
    null = bootstrap.bootstrap_null(df, 200).collect()
    crit = bootstrap.critical_values(df).first().critical
    assert got[101].n_nonsig == sum((2.2 - r.boot_mean) / r.boot_std <= crit for r in null)
    calls = {r.variant_id: r for r in impact.call_effects(impact.fold_change(impact.test_effects(df, params)), fc_cut=1.0).collect()}
    assert [calls[i].is_sig for i in (100, 102, 103, 104)] == [False, True, True, False]
    assert abs(calls[102].fold_change - (9.0 - np.mean(bg))) < 1e-9


def test_full_bootstrap_queries(spark, sf_dir, monkeypatch):
    # The registered job over one locus and context, drawn 10,000 times by brute force.
    locus, context = load(spark, sf_dir, "fx_gwas").agg(F.min("locus_id")).first()[0], 4
    few = {"fx_gwas": load(spark, sf_dir, "fx_gwas").filter(F.col("locus_id") == locus).collect()}
    few["fx_effects"] = load(spark, sf_dir, "fx_effects").filter((F.col("locus_id") == locus) & (F.col("context_id") == context)).collect()
    monkeypatch.setattr(registry, "load", lambda spark, _, name: spark.createDataFrame(few[name], load(spark, sf_dir, name).schema))
    labelled = core.joined(*(registry.load(spark, sf_dir, name) for name in few))
    group = labelled.collect()
    assert len({r.var_label for r in group}) > 1
    x = np.array([v for _, v in sorted((r.variant_id, abs(r.effect)) for r in group if r.var_label == "background")])
    got = x[bootstrap.draws(np.arange(10_000), len(x), context, locus)]
    crit = bootstrap.critical_values(labelled).filter(F.col("locus_id") == locus).first().critical
    limit = got.mean(axis=1) + crit * np.maximum(got.std(axis=1), 0.01)
    want = sorted((r.variant_id, r.var_label, 1.0 if r.var_label == "background" else (int((abs(r.effect) <= limit).sum()) + 1) / 10_001) for r in group)
    made = full_queries()["boot_pvals_full"](spark, sf_dir)
    assert sorted((r.variant_id, r.var_label, r.p_value) for r in made.collect()) == want
    names = ("boot_null", "boot_counts", "boot_pvals", "call_sig", "agg_impact_calls", "agg_call_summary", "pipe_impact_map", "call_volcano")
    assert set(full_queries()) == {f"{n}_full" for n in names}


def test_full_tokens_see_the_whole_sequence(spark):
    seqs = ["ACGTN" * 60, "ACGTN" * 59 + "ACGTA"]
    got = genome_queries.fn_tokens_full(spark.createDataFrame(list(enumerate(seqs)), "doc_id long, seq string"))
    want = [(i, hashlib.md5(",".join(str("ACGTN".index(c)) for c in s).encode()).hexdigest()) for i, s in enumerate(seqs)]
    assert rows(got, "doc_id", "tokens") == want and want[0][1] != want[1][1]


def test_full_matrix_returns_every_effect(spark):
    names = [(c, a) for c in ("X", "Y", "Z", "U") for a in ("ATAC-seq", "minus strand polyA plus RNA-seq")]
    ctx = spark.createDataFrame([(i, f"{c}---{a}", c, a) for i, (c, a) in enumerate(names)], "context_id long, context string, celltype string, assay string")
    effects = spark.createDataFrame([(v, i, f"{c}---{a}", v + i / 10) for v in range(3) for i, (c, a) in enumerate(names)], "variant_id long, context_id long, context string, effect double")
    want = sorted((v, c, a, v + i / 10) for v in range(3) for i, (c, a) in enumerate(names))
    assert sorted(map(tuple, core.agg_matrix_unpivot_full(effects, ctx).select("row_id", "celltype", "assay", "effect").collect())) == want
    assert core.agg_matrix_pivot_full(effects, ctx).count() == 12


def test_matrix_query_takes_every_cell_type_and_assay(spark):
    names = [(c, a) for c in ("BUILDING", "HOUSEHOLD", "MACHINERY") for a in ("ATAC-seq", "minus strand polyA plus RNA-seq")]
    ctx = spark.createDataFrame([(i, f"{c}---{a}", c, a) for i, (c, a) in enumerate(names)], "context_id long, context string, celltype string, assay string")
    effects = spark.createDataFrame([(v, i, f"{c}---{a}", v + i / 10) for v in range(2) for i, (c, a) in enumerate(names)], "variant_id long, context_id long, context string, effect double")
    got = core.agg_matrix_pivot(effects, ctx)
    assert rows(got, "row_id", "celltype", "ATAC-seq", "minus strand polyA plus RNA-seq") == [(v, names[i][0], v + i / 10, v + (i + 1) / 10) for v in range(2) for i in (0, 2, 4)]


def test_draws_are_added_in_order_in_little_memory():
    """Means equal a sum that takes one draw after another, and no array grows with draws times boots."""
    xs = np.random.default_rng(2).integers(0, 1001, 30_000) / 500
    tracemalloc.start()
    made = [(mean, std) for _, mean, std in bootstrap.moments(xs, 300, 7, 3)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000
    got = xs[bootstrap.draws(np.arange(300), len(xs), 7, 3)]
    assert np.concatenate([m for m, _ in made]).tolist() == (np.add.accumulate(got, axis=1)[:, -1] / len(xs)).tolist()
    assert np.allclose(np.concatenate([s for _, s in made]), got.std(axis=1), rtol=1e-12)
    odd = list(bootstrap.moments(np.array([1e9, 1e9 + 1, np.inf]), 40, 0, 0))[0]
    kept = [set(d) for d in bootstrap.draws(np.arange(40), 3, 0, 0).tolist()]
    assert [bool(np.isfinite(m)) for m in odd[1]] == [2 not in k for k in kept]
    assert all(abs(s - 0.4714) < 1e-3 for s, k in zip(odd[2], kept) if k == {0, 1})


def test_null_is_the_same_however_contexts_are_dealt(spark, monkeypatch):
    data = [(locus, c, v, "background", (v * 37 + c * 11 + locus) % 101 / 10) for locus in (1, 2) for c in range(5) for v in range(40)]
    df = spark.createDataFrame(data, "locus_id long, context_id long, variant_id long, var_label string, effect double")
    expected = rows(bootstrap.bootstrap_null(df, 30))
    assert len(expected) == 2 * 5 * 30
    for parts in (1, 2):
        monkeypatch.setattr(bootstrap, "locus_parts", lambda *_, parts=parts: parts)
        assert rows(bootstrap.bootstrap_null(df, 30)) == expected
        got = bootstrap.background_arrays(df, 30).withColumn("task", F.spark_partition_id())
        assert got.groupBy("locus_id").agg(F.countDistinct("task").alias("n")).filter(F.col("n") > parts).count() == 0


def test_long_boots_share_windows_of_one_circle(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = [3000, 3000, 2000, 3000, 1]
    groups = [(7, c, 2.0, np.abs(rng.normal(size=n))) for c, n in enumerate(sizes)] + [(8, 0, 3.0, np.full(3000, np.inf))]
    plain = list(bootstrap.boot_moments(groups, 200, 3))
    monkeypatch.setattr(bootstrap, "SHARED", 1)
    shared = list(bootstrap.boot_moments(groups, 200, 3))
    assert [g[:3] for g in shared] == [g[:3] for g in groups] == [g[:3] for g in plain]
    for (_, _, _, mean, std), (*_, mean_1, std_1) in zip(plain, shared):
        assert np.allclose(mean, mean_1, rtol=1e-12, equal_nan=True) and np.allclose(std, std_1, rtol=1e-12, equal_nan=True)
    drawn = groups[1][3][bootstrap.draws(np.arange(200), 3000, 1, 7, 3).astype(np.int64)]
    assert np.allclose(shared[1][3], drawn.mean(axis=1), rtol=1e-12) and np.allclose(shared[1][4], drawn.std(axis=1), rtol=1e-12)
    # Windows that cover the circle more than once, and one that passes its end.
    w = bootstrap._Windows(rng.normal(size=1 << 16), 1 << 17, bootstrap.group_key(0, 7))
    assert (w.end > w.first).all() and w.drawn.mean() > 0.8 and (w.end >= len(w.cuts)).any()
    # 1 GB: 50 loci of 25 contexts with 126,000 effects each; with few boots, or short ones, groups go anywhere.
    assert bootstrap.locus_parts(1250 * 126_000, 50, 1250, 10_000, 12) == 1
    assert bootstrap.locus_parts(1250 * 126_000, 50, 1250, 120, 12) is None
    assert bootstrap.locus_parts(0, 0, 0, 10_000, 12) is None


def test_boots_by_counts_of_blocks_are_the_plain_draws(monkeypatch):
    rng = np.random.default_rng(5)
    distinct = np.abs(rng.normal(size=(50, 3)))
    keys = [bootstrap.group_key(c, 7, 3) for c in range(3)]
    for table in (distinct[rng.integers(0, 50, 40_000)], np.abs(rng.normal(size=(40_000, 3)))):
        rows, code = bootstrap._coded(table)
        assert (rows[code] == table).all() and len(rows) == len(np.unique(table, axis=0))
        for length in (1 << 14, 1 << 16):  # boots of several blocks, and of none whole
            got = list(bootstrap.counted_moments(rows, code, 40, keys, length))
            for c, (mean, std) in enumerate(got):
                drawn = table[:, c][bootstrap.draws(np.arange(40), 40_000, c, 7, 3)]
                assert np.allclose(mean, drawn.mean(axis=1), rtol=1e-12) and np.allclose(std, drawn.std(axis=1), rtol=1e-11)
    # A boot that passes the end of the circle.
    late = int(np.argmax((bootstrap.mix(keys[0] ^ np.arange(1 << 17, dtype=np.uint32)) * np.uint32(bootstrap.STEP_INVERSE))))
    monkeypatch.setattr(bootstrap, "group_key", lambda *_, plain=bootstrap.group_key: plain(0, 7, 3) ^ np.uint32(late))
    key = bootstrap.group_key(0, 7)
    (mean, std), *_ = bootstrap.counted_moments(rows[:, :1], code, 1, [key], 1 << 14)
    drawn = table[:, 0][bootstrap.draws(np.arange(1), 40_000, 0, 7)]
    assert np.allclose(mean, drawn.mean(axis=1), rtol=1e-12) and np.allclose(std, drawn.std(axis=1), rtol=1e-11)
    # Many draws of few distinct rows are counted; draws of rows that all differ are gathered.
    assert bootstrap._block_length(126_000, 10_000, 2003, 25) == 1 << 14
    assert bootstrap._block_length(126_000, 10_000, 126_000, 25) is None


@pytest.mark.parametrize("step", [1, 1 << 40])
def test_packed_groups_hold_every_effect(step):
    rng = np.random.default_rng(5)
    locus, context, ids = rng.integers(-3, 4, 500) * step, rng.integers(0, 5, 500) * step, rng.permutation(500)
    batch = pa.RecordBatch.from_arrays([pa.array(a) for a in (locus, context, ids, ids * 0.5)], names=["locus_id", "context_id", "variant_id", "x"])
    made = [b for b in bootstrap.pack([batch.slice(0, 200), batch.slice(200)])]
    got = {(locus, context): xs.tolist() for locus, context, _, xs in bootstrap.groups(made)}
    want = {}
    for a, b, i in sorted(zip(locus.tolist(), context.tolist(), ids.tolist())):
        want.setdefault((a, b), []).append(i * 0.5)
    assert got == want


def test_boot_null_rounds_half_places(spark, monkeypatch):
    # 160 draws of steps of 0.002: some means lie halfway between six places.
    df = labelled(spark, [0.002 * (i % 7) for i in range(160)], [1.0])
    monkeypatch.setattr(core, "joined", lambda *_: df)
    got = {r.boot: r.boot_mean for r in core.boot_null(None, None).collect()}
    xs = np.array([0.002 * (i % 7) for i in range(160)])
    drawn = xs[bootstrap.draws(np.arange(120), 160, 0, 1)]
    means = np.add.accumulate(drawn, axis=1)[:, -1] / 160
    assert got == {b: np.floor(m * 1e6 + 0.5) / 1e6 for b, m in enumerate(means)}


def test_boot_null_query_draws_as_often_as_its_operator(spark, monkeypatch):
    df = labelled(spark, [0.5 * (i % 7) for i in range(12)], [1.0])
    monkeypatch.setattr(core, "joined", lambda *_: df)
    monkeypatch.setattr(registry, "load", lambda *_: None)
    assert registry.QUERIES["boot_null"](spark, "").count() == impact.Params().n_boots == 10_000
    assert "range(10000)" in registry.ORACLES["boot_null"]


def test_counts_cover_variants_labelled_other(spark, sf_dir):
    locus = stratify.stratify(load(spark, sf_dir, "fx_gwas")).filter("var_label = 'other'").agg(F.min("locus_id")).first()[0]
    of, effects = (load(spark, sf_dir, name).filter(F.col("locus_id") == locus) for name in ("fx_gwas", "fx_effects"))
    want = rows(stratify.stratify(of).crossJoin(spark.range(25)), "variant_id", "id", "var_label")
    got = core.boot_counts(of, effects).collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(want) and {r.var_label for r in got} >= {"other", "background"}
    # Their tests count for the critical value.
    n_tests = sum(r.var_label != "background" for r in got)
    assert bootstrap.critical_values(core.tested(of, effects, every=True)).first().n_tests == n_tests


def test_thresholds_are_drawn_once_and_background_is_not_dealt(spark):
    """A hot group's tasks share its thresholds, and rows of the background keep their partitions."""
    rng = np.random.default_rng(3)
    df = labelled(spark, rng.normal(0, 1, 50).tolist(), rng.normal(0, 3, 40).tolist()).coalesce(1)
    found = bootstrap.count_nonsig(df, 20, group_rows=5)
    placed = found.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in placed if r.var_label == "background"}) == 1
    assert len({r.task for r in placed if r.var_label != "background"}) > 1
    limits = bootstrap.thresholds(df, bootstrap.critical_values(df), 20).collect()
    assert len(limits) == 1 and len(limits[0].limits) == 20
    assert all(r.n_nonsig == sum(abs(r.effect) <= x for x in limits[0].limits) for r in placed if r.var_label != "background")


def test_calls_of_one_label(spark):
    rng = np.random.default_rng(4)
    df = labelled(spark, rng.normal(0, 1, 50).tolist(), rng.normal(0, 3, 40).tolist()).withColumn("var_label", F.expr("CASE WHEN variant_id < 50 THEN var_label WHEN variant_id % 2 = 0 THEN 'rare' ELSE 'candidate' END"))
    params = impact.Params(n_boots=50)
    names = ("variant_id", "n_nonsig", "p_value", "fold_change", "is_sig")
    whole = impact.test_calls(df, params).filter("var_label = 'candidate'")
    assert rows(impact.test_calls(df, params, only="candidate"), *names) == rows(whole, *names)


def test_effects_meet_labels_and_rows_without_being_dealt(spark, sf_dir):
    effects = load(spark, sf_dir, "fx_effects")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    joined = plan(core.joined(load(spark, sf_dir, "fx_gwas"), effects))
    assert "ShuffledHashJoin" in joined
    made = plan(core.agg_matrix_unpivot(effects))
    assert made.count("Exchange hashpartitioning(row_id") == 0 and made.count("REPARTITION_BY_NUM") == 1


def test_effects_are_ordered_without_being_dealt(spark):
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("celltype"), F.lit(a).alias("assay")) for c in ("c1", "c2") for a in ("a", "b"))))
    lying = spark.range(40).toDF("row_id").repartition(3, "row_id").select("row_id", cells.alias("at")).select("row_id", "at.*", (F.hash("row_id", "at") % 9 / 4).alias("effect"))
    made = scoring.order_effects(lying)
    text = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(row_id" in text and text.count("REPARTITION_BY_NUM") == text.count("Exchange ") and "SortMergeJoin" not in text
    assert made.count() == 160
    data = [("c1", "a", 1.0), ("c1", "b", -3.0), ("c2", "b", 3.0), ("c2", "c", float("nan")), ("c3", "d", None), ("c4", "a", 0.5), (None, "b", 3.0), ("c5", None, 9.0)]
    effects = spark.createDataFrame([(7, *r) for r in data] + [(None, "c1", "a", 1.0), (8, "c1", "z", 2.0), (8, "c2", "y", 2.0)], "row_id long, celltype string, assay string, effect double")
    got = scoring.order_effects(effects, 2)
    want = [(7, "c1", "a", 3, 2), (7, "c1", "b", 2, 2), (7, "c2", "b", 2, 1), (7, "c2", "c", 1, 1), (7, "c3", "d", 4, None), (7, "c4", "a", 3, None), (7, None, "b", 2, None)]
    want += [(8, "c1", "z", 2, 1), (8, "c2", "y", 1, 2)]
    assert rows(got, "row_id", "celltype", "assay", "assay_rank", "celltype_rank") == sorted(want, key=repr)


def test_matrices_gathered_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x", 0.5, True), (1, "a", "y", None, False), (1, "b", "x", 2.0, None)], "id long, kind string, context string, v double, s boolean")
    paths = sinks.write_matrices(df, f"file://{tmp_path}/m", {"vs": "v", "ss": "s"}, ("id", "kind"), "name")
    got = readers.read_matrix(spark, paths["vs"], "v", "name", "string")
    assert rows(got) == sorted([("1:a", "x", 0.5), ("1:a", "y", None), ("1:b", "x", 2.0), ("1:b", "y", None)], key=repr)
    got = readers.read_matrix(spark, paths["ss"], "s", "name", "string", "boolean")
    assert rows(got) == sorted([("1:a", "x", True), ("1:a", "y", False), ("1:b", "x", None), ("1:b", "y", None)], key=repr)


def test_written_impact_leaves_only_compressed_outputs(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda _: f"file://{tmp_path}")
    locus = load(spark, sf_dir, "fx_gwas").agg(F.min("locus_id")).first()[0]
    of, effects = (load(spark, sf_dir, name).filter(F.col("locus_id") == locus) for name in ("fx_gwas", "fx_effects"))
    params = impact.Params(n_boots=20)
    want = rows(impact.test_calls(core.tested(of, effects, "context"), params), "locus_id", "variant_id", "var_label", "context", "n_nonsig")
    before = {p.name for p in tmp_path.iterdir()}
    paths = impact.write_impact(of, effects, f"file://{tmp_path}/made", params)
    left = {p.name.split("-")[0].split(".")[0] for p in tmp_path.iterdir() if p.name not in before}
    assert left <= {"made", "loci", "ranges", "short"}
    parts = [p for name in paths for p in (tmp_path / f"made.{name}").glob("part-*")]
    assert parts and all(p.name.endswith(".gz") for p in parts)
    got = readers.read_matrix(spark, paths["boot_counts"], "n", "variant", "string").filter("n IS NOT NULL")
    assert rows(got.select(*(F.split("variant", ":")[i].alias(c) for i, c in enumerate(("a", "b", "c"))), "context", F.col("n").cast("long"))) == sorted(((str(a), str(b), c, d, n) for a, b, c, d, n in want), key=repr)


def test_std_floor(spark):
    null = bootstrap.bootstrap_null(labelled(spark, [1.0] * 10, [1.0]), 5).collect()
    assert all(r.boot_std == 0.01 and r.boot_mean == 1.0 for r in null)


SIG = "row_id long, context string, bin_idx int, ref_signal double, alt_signal double"


def test_scores(spark):
    df = spark.createDataFrame([(1, "a", 0, 1.0, 3.0), (1, "a", 1, 2.0, 1.0), (2, "a", 0, 1.0, 1.0)], SIG)
    score = lambda d, m: dict(rows(scoring.score_effects(d, m), "row_id", "effect"))
    assert score(df, "signed_sum_abs") == score(df, "sign_sum_abs") == {1: 3.0, 2: 0.0}
    assert score(df, "sum_logfc") == {1: 1.0, 2: 0.0}
    assert score(df, "log_ratio")[2] == 1.0
    swapped = df.select("row_id", "context", "bin_idx", F.col("alt_signal").alias("ref_signal"), F.col("ref_signal").alias("alt_signal"))
    assert score(swapped, "signed_sum_abs")[1] == -3.0
    with pytest.raises(ValueError):
        scoring.score_effects(df, "other")


def test_effect_normalisation(spark):
    df = spark.createDataFrame([(1, "c1", "x RNA-seq", 2.0), (1, "c2", "x RNA-seq", -1.0), (1, "c1", "ATAC", 0.5), (1, "c2", "ATAC", 0.1)], "row_id long, celltype string, assay string, effect double")
    got = {(r.celltype, r.assay): r.normed for r in scoring.normalise_effects(df).collect()}
    assert got == {("c1", "x RNA-seq"): 1.0, ("c2", "x RNA-seq"): 0.25, ("c1", "ATAC"): 0.5, ("c2", "ATAC"): 0.1}


def test_tracks(spark):
    df = spark.createDataFrame([(1, "k RNA-seq", 0, 2.0, 4.0), (1, "k RNA-seq", 1, 4.0, 1.0), (1, "z", 0, 0.0, 1.0)], SIG)
    normed = {(r.context, r.bin_idx): (r.ref_normed, r.alt_normed, r.context_rank) for r in tracks.normalise_tracks(df).collect()}
    assert normed == {("k RNA-seq", 0): (0.25, 1.0, 1), ("k RNA-seq", 1): (1.0, 0.0625, 1), ("z", 0): (None, None, 2)}
    diff = {(r.context, r.bin_idx): r["diff"] for r in tracks.diff_tracks(tracks.normalise_tracks(df)).collect()}
    assert diff == {("k RNA-seq", 0): 0.5, ("k RNA-seq", 1): -0.75, ("z", 0): None}
    top = {r.context: r.summary for r in tracks.summarise_track(df, "top_mean", k=1).collect()}
    assert top == {"k RNA-seq": 4.0, "z": 0.0}
    with pytest.raises(ValueError):
        tracks.summarise_track(df, "median")


def test_bins_match_published_geometry(spark):
    start = 31076838 - 1 - 196608 // 2 + 1  # in the user's 1-based coordinates
    df = tracks.bins(spark.createDataFrame([(1, "chr8", start)], "row_id long, chrom string, window_start long"))
    assert df.count() == 896
    first = df.orderBy("bin_idx").first()
    assert (first.bin_start, first.bin_end) == (31019494, 31019622)


def test_regions(spark):
    sig = spark.createDataFrame([(1, "chr1", 0, 0, 128), (1, "chr1", 1, 128, 256), (2, "chr1", 0, 0, 128)], "row_id long, chrom string, bin_idx int, bin_start long, bin_end long")
    regions = spark.createDataFrame([(1, 128, 130), (2, None, None), (3, 5, 9)], "row_id long, effect_start long, effect_end long")
    kept = tracks.restrict_to_region(sig, regions)
    assert rows(kept, "row_id", "bin_idx") == [(1, 1), (2, 0)]
    assert [r.row_id for r in tracks.empty_regions(kept, regions).collect()] == [3]


def test_overlaps_span_bins(spark):
    iv = spark.createDataFrame([("c", 0, 500, "whole"), ("c", 99, 100, "edge"), ("c", 200, 210, "none"), ("d", 0, 500, "other")], "chrom string, start0 long, end0 long, feature string")
    win = spark.createDataFrame([(1, "c", 50, 100), (2, "c", 100, 200), (3, "c", 0, 400)], "win_id long, chrom string, win_start long, win_end long")
    got = rows(intervals.overlap_join(iv, win, width=64), "win_id", "feature")
    assert got == sorted([(1, "whole"), (2, "whole"), (3, "whole"), (1, "edge"), (3, "edge"), (3, "none")], key=repr)
    assert intervals.overlap_join(iv.limit(0), win).count() == 0


def windows(spark, seq, variants, **options):
    ref = spark.createDataFrame([("c", seq)], "contig string, seq string")
    contigs = ref.select("contig", F.length("seq").cast("long").alias("length"))
    v = spark.createDataFrame(variants, "row_id long, chromosome string, position long, ref string, alt string")
    return {r.row_id: r for r in genome.build_windows(v, genome.chunked(ref, 4), contigs, window=8, chunk=4, **options).collect()}


def test_windows_by_hand(spark):
    seq = "acgtACGTTTGG"
    got = windows(spark, seq, [(1, "c", 6, "g", "T"), (2, "c", 1, "C", "GA"), (3, "c", 11, "G", "GGGG"), (4, "c", 5, "C", ""), (5, "c", 6, "A", "T"), (6, "c", 5, "CG", "T")])
    assert (got[1].ref_seq, got[1].alt_seq) == ("GTACGTTT", "GTACTTTT")
    assert (got[2].ref_seq, got[2].alt_seq) == ("NNNACGTA", "NNNAGAGT")  # nine letters: the last one goes
    assert got[3].ref_seq == "GTTTGNNN"[:0] + "TTTGGNNN" and got[3].alt_seq == "TTGGGGGN"
    assert (got[5].status, got[5].ref_seq) == ("mismatch", None)
    assert (got[6].ref_seq, got[6].alt_seq) == ("CGTACGTT", "CGTATTT")
    fixed = windows(spark, seq, [(5, "c", 6, "A", "T")], correct_ref=True)[5]
    assert (fixed.status, fixed.ref_seq, fixed.alt_seq) == ("corrected", "GTACATTT", "GTACTTTT")
    based = windows(spark, seq, [(1, "c", 7, "G", "T")], index_base=1)[1]
    assert based.ref_seq == "GTACGTTT"
    assert windows(spark, seq, [(9, "c", 11, "GGGGGGGGG", "T")])[9].status == "outside"


def test_validation(spark):
    ref = genome.chunked(spark.createDataFrame([("c", "ACGTACGT")], "contig string, seq string"), 3)
    v = spark.createDataFrame([(1, "c", 2, "GT", "A"), (2, "c", 2, "A", "C"), (3, "c", 7, "TT", "C"), (4, "d", 1, "A", "C")], "row_id long, chromosome string, position long, ref string, alt string")
    checked = genome.validate_variants(v, ref, chunk=3)
    assert dict(rows(checked, "row_id", "status")) == {1: "ok", 2: "mismatch", 3: "outside", 4: "outside"}
    assert tuple(genome.validation_report(checked).first()) == (4, 3)


def test_tokens_and_splice(spark):
    df = spark.createDataFrame([("acGTN",), ("AXC",), ("",)], "s string").select(fn.dna_tokens("s").alias("t"))
    assert [r.t for r in df.collect()] == [[0, 1, 2, 3, 4], None, []]


def test_student_t():
    # Known values: two-sided tails for 1 and 10 degrees of freedom.
    assert abs(evaluate.two_sided_t(np.array([1.0]), np.array([1.0]))[0] - 0.5) < 1e-9
    assert abs(evaluate.two_sided_t(np.array([2.228139]), np.array([10.0]))[0] - 0.05) < 1e-6
    assert abs(evaluate.two_sided_t(np.array([0.0]), np.array([5.0]))[0] - 1) < 1e-9
    assert evaluate.two_sided_t(np.array([40.0]), np.array([30.0]))[0] < 1e-20


def test_tested_effects_are_not_dealt_to_meet_their_background(spark):
    data = [(v, v % 2, "background" if v < 20 else "rare", c, float((v * 7 + c) % 13)) for v in range(40) for c in (0, 1)] + [(90, 5, "rare", 0, 1.0)]
    df = spark.createDataFrame(data, "variant_id long, locus_id long, var_label string, context_id long, effect double")
    found = evaluate.background_ttest(df, "rows")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    got = found.collect()
    assert len(got) == 40 and {r.locus_id for r in got} == {0, 1}  # a locus without background is not tested, but counts
    assert all(abs(r.p_adj - min(1.0, r.p * 41)) < 1e-12 for r in got)
    bg = [float((v * 7) % 13) for v in range(0, 20, 2)]
    one = next(r for r in got if (r.variant_id, r.context_id) == (20, 0))
    assert one.dof == 9 and abs(one.t - (10.0 - np.mean(bg)) / (np.std(bg, ddof=1) / 10**0.5)) < 1e-9


def test_ttest_p(spark):
    df = labelled(spark, [1.0, 2.0, 3.0, 4.0], [10.0])
    r = evaluate.background_ttest(df, n_tests=5).first()
    sem = np.std([1, 2, 3, 4], ddof=1) / 2
    assert abs(r.t - (10 - 2.5) / sem) < 1e-9 and r.dof == 3 and 0 < r.p < 0.01 and abs(r.p_adj - min(1, 5 * r.p)) < 1e-12


def test_predictors(spark):
    rng = np.random.default_rng(2)
    w = {"genome_w": rng.normal(size=(3, 4)), "genome_b": np.zeros(3), "layers": [(rng.normal(size=(2, 5)), np.zeros(2))], "out_w": rng.normal(size=(1, 2)), "out_b": np.zeros(1)}
    x, v = rng.normal(size=(6, 4)), rng.normal(size=(6, 2))
    assert inference.head_predictor(w)(x, v).shape == (6, 1) and (inference.head_predictor(w)(x, v) >= 0).all()
    assert inference.head_predictor(w, stage="genome")(x, v).shape == (6, 3)
    hidden = inference.head_predictor(w, layer_norm=True, activation="relu", stage=0)(x, v)
    assert hidden.shape == (6, 2) and (hidden >= 0).all()
    batch = pd.DataFrame({"context_id": [9], "ref_bin": ["GCAT"], "alt_bin": ["AAAT"]})
    assert [a[0] for a in inference.gc_predictor(batch)] == [2.0, 0.0]


def test_contexts(spark):
    cat = spark.createDataFrame([("a---x", "a", "x", "train"), ("b---y", "b", "y", "test")], "context string, celltype string, assay string, allocation string")
    assert contexts.context_grid(cat, cat).count() == 4
    bad = filters.validate_contexts(spark.createDataFrame([("a---x",), ("a---x",), ("q---x",)], "context string"), cat)
    assert rows(bad) == [("a---x", "duplicate"), ("q---x", "unknown")]
    genes = spark.createDataFrame([("g", 5, 9, "gene"), ("g", 1, 2, "exon")], "gene_id string, start_pos long, end_pos long, feature string")
    got = contexts.attach_gene(spark.createDataFrame([("g",), ("h",)], "gene_id string"), genes)
    assert rows(got, "gene_id", "effect_start") == [("g", 1), ("h", None)]


def test_lanes(spark):
    data = [(1, 0, 50, "gene", "A", "a"), (1, 1, 9, "exon", "A", "a"), (1, 10, 20, "exon", "A", "a"), (1, 30, 40, "exon", "B", "b"), (1, 45, 48, "exon", "A", "a")]
    df = spark.createDataFrame(data, "win_id long, start0 long, end0 long, feature string, gene_name string, gene_id string")
    assert [r.lane for r in intervals.annotation_lanes(df).orderBy("start0").collect()] == [1, 1, 1, 2, 3]


def test_readers(spark, tmp_path):
    (tmp_path / "list.txt").write_text("kidney, left,,heart,,liver\n")
    assert rows(readers.read_name_list(spark, str(tmp_path / "list.txt"))) == [(0, "kidney, left"), (1, "heart"), (2, "liver")]
    (tmp_path / "v.tsv").write_text("CHR\tPOS\tREF\tALT\nchr1\t5\ta\tc\nchr1\t5\ta\tc\nchr2\t7\tG\tT\n")
    got = rows(readers.read_variants(spark, str(tmp_path / "v.tsv")), "row_id", "chromosome", "position", "ref")
    assert got == [(0, "chr1", 5, "A"), (1, "chr1", 5, "A"), (2, "chr2", 7, "G")]
    (tmp_path / "t.tsv").write_text("bin\ta---x\nchr_un_1_0_128\t0.5\n")
    assert rows(readers.read_signals(spark, str(tmp_path / "t.tsv"))) == [("chr_un_1", 0, 128, "a---x", 0.5)]
    (tmp_path / "a.gtf").write_text('# note\nchr1\ts\tgene\t11\t20\t.\t+\t.\tgene_id "G1"; gene_name "N";\nchr1\ts\texon\t11\t12\t.\t-\t.\tgene_id "G2";\n')
    assert rows(readers.read_gtf(spark, str(tmp_path / "a.gtf"), ("gene",))) == [("chr1", 10, 20, "gene", "+", "G1", "N")]
    assert readers.read_gtf(spark, str(tmp_path / "a.gtf")).filter("gene_name IS NULL").count() == 1
    (tmp_path / "a.bed").write_text("chr1\t1\t5\tname\t0\n")
    assert rows(readers.read_bed(spark, str(tmp_path / "a.bed"))) == [("chr1", 1, 5, "name", "0")]
    (tmp_path / "c.tsv").write_text("celltype_assay\tallocation\nT cell---RNA---x\ttrain\n")
    assert rows(readers.read_contexts(spark, str(tmp_path / "c.tsv")), "celltype", "assay") == [("T cell", "RNA---x")]


def test_reference_reader(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">c1 x\nacgta\nCGTNN\nAC\n>c2\nTT\n")
    (tmp_path / "r.fa.fai").write_text("c1\t12\t6\t5\t6\nc2\t2\t25\t2\t3\n")
    chunks, contigs = readers.read_reference(spark, f"file://{tmp_path}/r.fa", str(tmp_path / "r.fa.fai"), chunk=7)
    assert rows(chunks, "contig", "chunk", "chunk_start", "seq") == [("c1", 0, 0, "ACGTACG"), ("c1", 1, 7, "TNNAC"), ("c2", 0, 0, "TT")]
    assert rows(contigs) == [("c1", 12), ("c2", 2)]


def test_matrix_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", 0.5), (1, "a", 1.5), (2, "a", 2.5)], "row_id long, context string, effect double")
    path = sinks.write_matrix(df, f"{tmp_path}/x", "context_effects", "effect")
    back = readers.read_matrix(spark, path, "effect").filter("effect IS NOT NULL")
    assert rows(back) == rows(df)
    sinks.write_bedgraph(spark.createDataFrame([("chr1", 5, 0.5)], "chromosome string, position long, score double"), "score", f"{tmp_path}/b")
    assert spark.read.text(f"{tmp_path}/b").first()[0] == "chr1\t5\t6\t0.5"


# --- clashing columns, unknown contigs and the remaining operators -----------------------------------


def test_columns_of_the_caller_stay(spark):
    clash = ["any_sig", "range_start", "open", "common", "short", "bin", "new", "freq", "top", "m", "value", "below", "is_threshold"]
    gwas = spark.createDataFrame(
        [(i, i % 2, "chr1", 100 * i, "A", "C", 0.3, 0.5 + i / 100) for i in range(40)] + [(99, 0, "chr1", 50, "A", "C", None, None)],
        "variant_id long, locus_id long, chromosome string, position long, ref string, alt string, allele_freq double, p_value double",
    ).select("*", *(F.lit(c).alias(c) for c in clash))
    for made in (stratify.stratify(gwas), stratify.stratify_simple(gwas), intervals.order_points(stratify.stratify(gwas))):
        assert set(clash) <= set(made.columns) and all(r[c] == c for r in made.limit(3).collect() for c in clash)
    assert stratify.stratify(gwas.limit(0)).count() == 0
    centers = spark.createDataFrame([(0, "chr1", 500)], "locus_id long, chrom string, center long")
    near = filters.locus_window(gwas, centers, 200, 200).collect()
    assert sorted(r.variant_id for r in near) == [4, 5, 6] and all(r.bin == "bin" for r in near)
    spans = gwas.select(F.col("chromosome").alias("chrom"), F.col("position").alias("start0"), (F.col("position") + 10).alias("end0"), "bin")
    windows = spark.createDataFrame([(1, "chr1", 0, 101)], "win_id long, chrom string, win_start long, win_end long")
    assert [r.bin for r in intervals.overlap_join(spans, windows).collect()] == ["bin"] * 3


def test_unknown_contigs_get_a_status(spark):
    contigs = spark.createDataFrame([("c1", "ACGTACGT" * 8, 64)], "contig string, seq string, length long")
    reference = genome.chunked(contigs, 16)
    rows = [(1, "c1", 4, "A", "G"), (2, "nowhere", 4, "A", "G"), (3, None, 4, "A", "G"), (4, "c1", None, "A", "G"), (5, "c1", 5, "A", "G")]
    variants = spark.createDataFrame(rows, "row_id long, chromosome string, position long, ref string, alt string")
    for correct in (False, True):
        made = {r.row_id: (r.status, r.ref_seq is None) for r in genome.build_windows(variants, reference, contigs, 16, correct_ref=correct, chunk=16).collect()}
        assert made[1] == ("ok", False) and made[2] == made[3] == made[4] == ("outside", True)
        assert made[5] == (("corrected", False) if correct else ("mismatch", True))


def test_effects_below_a_corrected_p(spark):
    rows = [(1, v, 1, "background", float(v % 5)) for v in range(30)] + [(1, 100, c, "candidate", 60.0) for c in (1, 1)] + [(1, 101, 1, "candidate", 2.0)]
    labelled = spark.createDataFrame(rows, "locus_id long, variant_id long, context_id long, var_label string, effect double")
    tested = evaluate.background_ttest(labelled, "rows")
    assert {r.variant_id: r.n_below for r in evaluate.effects_below(tested).collect()} == {100: 2, 101: 0}


def test_shared_folder_off_local_mode():
    from types import SimpleNamespace

    from allelic.sources import scratch

    conf = lambda found: SimpleNamespace(get=lambda key: found)
    session = lambda master, found=None: SimpleNamespace(sparkContext=SimpleNamespace(master=master, applicationId="a", getConf=lambda: conf(found)))
    with pytest.raises(RuntimeError):
        scratch.shared_dir(session("spark://host:7077"))
    with pytest.raises(RuntimeError):
        scratch.shared_dir(session("local-cluster[2,1,1024]"))
    assert scratch.shared_dir(session("yarn", "hdfs://x/tmp/")) == "hdfs://x/tmp" and scratch.shared_dir(session("local[4]")).startswith("file://")


def test_matrix_of_many_files_is_read_whole(spark, tmp_path):
    data = [(i, c, None if (i, c) == (3, "b c") else i / 4) for i in range(200) for c in ("a", 'b "c"', "b c")]
    df = spark.createDataFrame(data, "row_id long, context string, x double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = sinks.write_matrix(df, f"file://{tmp_path}/m", "x", "x")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "m.x").glob("part-*"))) > 1
    assert spark.read.csv(path, sep="\t", header=True, quote="").count() == 200
    assert rows(readers.read_matrix(spark, path, "x").filter("context = 'a'"), "row_id", "x") == sorted(((i, i / 4) for i in range(200)), key=repr)


def test_error_function():
    import math

    x = np.concatenate([np.linspace(-7, 7, 20_001), [0.0, 0.46875, -0.46875, 4.0, np.inf, -np.inf, np.nan]])
    want = np.array([math.erf(v) for v in x])
    assert np.nanmax(np.abs(inference._erf(x) - want)) < 1e-14
    assert np.isnan(inference._erf(x)[-1])


def test_effects_summed_inside_the_task(spark):
    """Sums over bins in the task equal scores of single signals, for any batches, blocks and parts of the catalogue."""
    bins = [(r, "c", b, b * 10, b * 10 + 10, "ACGT" * (b % 3), "GGCC" * ((r + b) % 4)) for r in range(5) for b in range(7)]
    df = spark.createDataFrame(bins, "row_id long, chrom string, bin_idx int, bin_start long, bin_end long, ref_bin string, alt_bin string").repartition(3)
    ctx = spark.createDataFrame([(i, f"x{i}") for i in range(6)], "context_id long, context string")
    keys = ("row_id", "context_id", "context")
    for mode in ("signed_sum_abs", "sum_diff", "log_ratio"):
        want = rows(scoring.score_effects(inference.predict(df, ctx, inference.gc_predictor), mode, keys).withColumn("effect", F.round("effect", 9)), *keys, "effect")
        for block, held in ((1024, 65_536), (4, 65_536), (2, 4)):
            got = inference.predict_effects(df, ctx, scoring_mode=mode, block=block, held=held).withColumn("effect", F.round("effect", 9))
            assert rows(got, *keys, "effect") == want and len(want) == 30
    assert inference.predict_effects(df, ctx.limit(0)).count() == 0 and inference.predict_effects(df.limit(0), ctx).count() == 0


def test_rows_without_a_region_keep_their_bins(spark):
    sig = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (2, 0, 10), (3, 0, 10)], "row_id long, bin_start long, bin_end long")
    regions = spark.createDataFrame([(1, 12, 15), (2, None, None)], "row_id long, effect_start long, effect_end long")
    assert rows(tracks.restrict_to_region(sig, regions), "row_id", "bin_start") == [(1, 10), (2, 0), (3, 0)]


def test_matrix_of_missing_pairs(spark):
    """A pair without an effect is null in the matrix and has no row when it is taken apart."""
    effects = spark.createDataFrame([(1, "X", "a", 1.0), (1, "Y", "b", 2.0), (2, "X", "b", None)], "row_id long, celltype string, assay string, effect double")
    matrix = scoring.to_matrix(effects, ["X", "Y"], ["a", "b"])
    assert sorted(map(tuple, matrix.collect())) == [(1, "X", 1.0, None), (1, "Y", None, 2.0), (2, "X", None, None)]
    assert sorted(map(tuple, scoring.from_matrix(matrix, ["a", "b"]).collect())) == [(1, "X", "a", 1.0), (1, "Y", "b", 2.0)]


def test_reference_in_files(spark, tmp_path):
    import hashlib

    from allelic.sources import reference

    contigs = {"c1": "ACGTNACGTTGCAAC", "c2": "GG", "c3": "TTGACA" * 20, "odd_name:1": "A"}
    rows = spark.createDataFrame([*contigs.items(), ("none", None), ("empty", "")], "contig string, seq string")
    reference.write_reference(genome.chunked(rows, 4), f"{tmp_path}/g", segment=8, line=3)
    ref = reference.open_reference(spark, f"{tmp_path}/g")
    assert {r.contig: r.length for r in ref.contigs().collect()} == {c: len(s) for c, s in contigs.items()}
    got = {}
    for r in sorted(ref.chunks(7).collect()):
        got[r.contig] = got.get(r.contig, "") + r.seq
        assert r.chunk_start == r.chunk * 7
    assert got == contigs
    # Ranges across segments, outside contigs, of unknown contigs and of null places; repeated rows stay.
    asked = [("c3", 5, 100), ("c3", 5, 100), ("c3", -3, 2), ("c3", 118, 130), ("c3", 500, 510), ("c1", 7, 9), ("c2", 1, 1), ("x", 0, 3), (None, 0, 3), ("c1", None, 3), ("c1", 3, None)]
    cut = ref.cut(spark.createDataFrame(asked, "contig string, from long, to long")).collect()
    want = [(c, a, b, len(contigs[c]) if c in contigs else None, contigs[c][max(a, 0) : b] or None if c in contigs and a is not None and b is not None else None) for c, a, b in asked]
    assert sorted(map(tuple, cut), key=repr) == sorted(want, key=repr)
    edits = [(1, "c3", 20, "G", "TAC"), (2, "c3", 0, "T", ""), (3, "c3", 119, "A", "C"), (4, "c3", 120, "A", "C"), (5, "x", 0, "A", "C"), (6, "c2", 1, None, "C"), (7, "c1", 14, "C", "G"), (8, "c3", 20, "GACA", "T")]
    for r in ref.edited_md5(spark.createDataFrame(edits, "row_id long, contig string, at long, ref string, alt string")).collect():
        whole = contigs.get(r.contig)
        inside = whole and None not in (r.at, r.ref) and r.at + len(r.ref) <= len(whole)
        assert r.md5 == (hashlib.md5((whole[: r.at] + r.alt + whole[r.at + len(r.ref) :]).encode()).hexdigest() if inside else None)
    none = spark.createDataFrame([], "contig string, from long, to long")
    assert ref.cut(none).count() == 0 and ref.cut(none).columns == ["contig", "from", "to", "length", "text"]
    with pytest.raises(Exception, match="does not follow"):
        reference.write_reference(genome.chunked(rows, 4).filter("chunk <> 2"), f"{tmp_path}/h", segment=8)
    reference.write_reference(genome.chunked(rows, 4).filter("chunk <> 1"), f"{tmp_path}/i", segment=8)
    with pytest.raises(Exception, match="gap in contig c"):
        reference.open_reference(spark, f"{tmp_path}/i").contigs().collect()


def test_one_fasta_file_as_reference(spark, tmp_path):
    from allelic.sources import reference

    (tmp_path / "r.fa").write_text(">c1\nACGTa\ncgtNN\nGT\n>c2\nGG\n")
    (tmp_path / "r.fa.fai").write_text("c1\t12\t4\t5\t6\nc2\t2\t23\t2\t3\n")
    for path in (f"{tmp_path}/r.fa", f"file:{tmp_path}/r.fa", f"file://{tmp_path}/r.fa"):
        ref = reference.open_fasta(spark, path, f"{tmp_path}/r.fa.fai")
        asked = spark.createDataFrame([("c1", 3, 11), ("c2", 0, 9), ("c1", 0, 12)], "contig string, from long, to long")
        assert rows(ref.cut(asked), "contig", "text") == [("c1", "ACGTACGTNNGT"), ("c1", "TACGTNNG"), ("c2", "GG")]


def test_windows_from_files_equal_those_from_chunks(spark, tmp_path):
    from allelic.sources import reference

    contigs = spark.createDataFrame([("c1", "ACGTNACGTTGCAAC" * 9), ("c2", "GGTT")], "contig string, seq string")
    chunks, lengths = genome.chunked(contigs, 4), contigs.select("contig", F.length("seq").cast("long").alias("length"))
    reference.write_reference(chunks, f"{tmp_path}/g", segment=16)
    ref = reference.open_reference(spark, f"{tmp_path}/g")
    v = spark.createDataFrame(
        [(i, "c1" if i % 3 else "c2", i * 7 - 3, "ACGT"[i % 4], "TG"[i % 2] * (1 + i % 3)) for i in range(24)] + [(90, "x", 3, "A", "C"), (91, "c1", None, "A", "C"), (92, None, 3, "A", "C")],
        "row_id long, chromosome string, position long, ref string, alt string",
    )
    for correct in (False, True):
        old = genome.build_windows(v, chunks, lengths, window=20, chunk=4, correct_ref=correct)
        assert sorted(map(repr, genome.build_windows(v, ref, window=20, correct_ref=correct).collect())) == sorted(map(repr, old.collect()))
    found = {r.row_id: (r.found_ref, r.status) for r in genome.validate_variants(v, ref).collect()}
    assert found.pop(0)[1] == "outside"
    old = {r.row_id: (r.found_ref, r.status) for r in genome.validate_variants(v.filter("position >= 0"), chunks, chunk=4).collect()}
    assert {k: x for k, x in found.items() if k in old} == old
    # One place that holds every row is dealt to many tasks, and no sequence is shuffled before it is cut.
    hot = spark.range(4000).selectExpr("id AS row_id", "'c1' AS chromosome", "50L AS position", "'A' AS ref", "'C' AS alt")
    made = genome.window_text(hot, ref, window=20)
    tasks = {r.n for r in made.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()}
    assert len(tasks) > 1 and max(tasks) < 4000
    assert made.select("seq").distinct().count() == 1


def test_overlaps_of_any_length(spark):
    import random

    draw = random.Random(5)

    def some(n):
        made = []
        for i in range(n):
            start = draw.choice([0, 15, 16, 255, 256, 4095, draw.randrange(5000)])
            made.append((i, draw.choice("ab"), start, start + draw.choice([0, 1, 15, 16, 17, 256, 300, 4096, 5000, 70_000])))
        return made

    a, b = some(150), some(60)
    left = spark.createDataFrame(a + [(900, "a", None, 4), (901, None, 1, 4), (902, "a", 1, None)], "gene long, chrom string, start0 long, end0 long")
    right = spark.createDataFrame(b + [(900, "a", None, 4), (901, None, 1, 4)], "win_id long, chrom string, win_start long, win_end long")
    got = [(r.gene, r.win_id) for r in intervals.overlap_join(left, right, width=1, levels=4).collect()]
    want = [(i, j) for i, c, s, e in a for j, d, t, u in b if c == d and s < u and e > t]
    assert sorted(got) == sorted(want) and len(set(got)) == len(got)
    # A contig-long interval has at most two bins of its own and of each coarser level.
    long = spark.createDataFrame([(1, "a", 5, 3_000_000_000)], "gene long, chrom string, start0 long, end0 long")
    one = spark.createDataFrame([(7, "a", 2_000_000_000, 2_000_000_100), (8, "a", 3_000_000_000, 3_000_000_001)], "win_id long, chrom string, win_start long, win_end long")
    assert [(r.gene, r.win_id) for r in intervals.overlap_join(long, one).collect()] == [(1, 7)]


def test_windows_from_files_are_bytes_and_their_variants_are_made_once(spark, tmp_path):
    """No cut walks over the characters of a window, and ranging the rows does not run again what makes them."""
    from allelic.sources import reference

    contigs = spark.createDataFrame([("a", "ACGTACGTACGTACG" * 4), ("b", "GG")], "contig string, seq string")
    reference.write_reference(genome.chunked(contigs, 4), f"{tmp_path}/bytes", 8)
    ref = reference.open_reference(spark, f"{tmp_path}/bytes")
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    data = [(i, "a", i, "ACGT"[i % 4], ("T", "GGA", "")[i % 3]) for i in range(45)] + [(100, "b", 1, "G", "TTTT"), (101, "b", 0, "A", "C"), (102, "c", 0, "A", "C")]
    v = spark.createDataFrame(data, "row_id long, chromosome string, position long, ref string, alt string")
    got = {r.row_id: r for r in genome.build_windows(v.mapInArrow(seen, v.schema), ref, window=12).collect()}
    assert made.value == len(data) == len(got)
    whole = {r.contig: r.seq for r in contigs.collect()}
    for i, contig, at, short, alt in data:
        if contig == "c":
            assert got[i].status == "outside" and got[i].ref_seq is None
            continue
        padded = "N" * 6 + whole[contig] + "N" * 12
        ok = whole[contig][at : at + 1] == short
        spliced = padded[at : at + 6] + alt + padded[at + 7 : at + 12]
        over = max(len(spliced) - 12, 0)
        assert (got[i].status, got[i].ref_seq) == (("ok", padded[at : at + 12]) if ok else ("mismatch", None))
        assert got[i].alt_seq == (spliced[over // 2 : over // 2 + 12] if ok else None)
    assert "binary" in genome.build_windows(v, ref, window=12)._jdf.queryExecution().optimizedPlan().toString()


def test_order_of_files(spark, tmp_path):
    header = "CHR\tPOS\tREF\tALT\n"
    lines = [f"c{i % 3}\t{i}\tA\tC\n" for i in range(5000)]
    (tmp_path / "v").mkdir()
    for k in range(5):
        (tmp_path / "v" / f"part-{k}.tsv").write_text(header + "".join(lines[k * 1000 : (k + 1) * 1000]))
    (tmp_path / "v" / "part-5.tsv").write_text(header)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("2000b", "128m"):  # many blocks of a file, many files of a task
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = readers.read_variants(spark, str(tmp_path / "v"))
            assert [(r.row_id, r.position) for r in df.orderBy("row_id").collect()] == [(i, i) for i in range(5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_first_of_a_hot_locus(spark):
    import random

    draw = random.Random(3)
    data = [(i, i % 2, draw.choice([0.1, 0.2, 0.3, None]), draw.choice([0.1, 0.5, None])) for i in range(600)]
    df = spark.createDataFrame([(v, locus, "chr1", v, "A", "C", af, p) for v, locus, p, af in data], GWAS)
    got = {r.variant_id for r in stratify.mark_candidates(df, stratify.Cuts(n_top=40)).filter("is_candidate").collect()}
    want = {v for k in (0, 1) for _, _, v in sorted((p is not None, p or 0.0, v) for v, locus, p, _ in data if locus == k)[:40]}
    assert got == want
    marked = df.withColumn("is_rare", F.lit(False))
    got = {r.variant_id for r in stratify.mark_background(marked, stratify.Cuts(min_bg=250)).filter("is_background").collect()}
    want = {v for k in (0, 1) for _, v in sorted((-af if af is not None else 9.0, v) for v, locus, p, af in data if locus == k and p is not None)[:250]}
    assert got == want
    twice = stratify.mark_candidates(df.union(df), stratify.Cuts(n_top=40)).filter("is_candidate")
    assert twice.count() == 80


@pytest.fixture
def small_ranges(spark):
    """Ranges as small as these tables stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_points_and_lanes_of_a_hot_locus(spark, small_ranges):
    """One locus with most rows is numbered in ranges, and equals a plain scan; ties and nulls too."""
    data = [(i, 0 if i % 10 else None, ["a", "b", None][i * i % 3], None if i % 17 == 0 else (i * 7919 % 101) / 101) for i in range(4000)]
    df = spark.createDataFrame(data, "variant_id long, locus_id long, var_label string, p_value double")
    for by, reverse in (("frequency", False), ("frequency", True), ("value", False), ("value", True)):
        got = {r.variant_id: r.point_order for r in intervals.order_points(df, by, reverse=reverse).collect()}
        want = {}
        for locus in (0, None):
            own = [r for r in data if r[1] == locus]
            freq = {x: sum(r[2] == x for r in own) for x in ("a", "b", None)}
            low = lambda x: (x is not None, x or "")
            if by == "frequency":
                own.sort(key=lambda r: (freq[r[2]] * (1 if reverse else -1), low(r[2]), r[0]))
            elif reverse:
                own.sort(key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))
            else:
                own.sort(key=lambda r: (r[3] is not None, r[3] or 0, r[0]))
            want |= {r[0]: n for n, r in enumerate(own, 1)}
        assert got == want
    ranges = intervals._in_ranges(df, "locus_id", F.asc("variant_id"))
    assert ranges.filter("locus_id = 0").select("__part").distinct().count() > 1
    assert intervals.order_points(df.limit(0)).count() == 0

    genes = [(0 if i % 10 else 1, i // 3, i // 3 + 5, ["gene", "exon", None][i % 7 % 3], ["A", "B", None, "C"][i // 5 % 4], f"g{i:05}") for i in range(3000)]
    df = spark.createDataFrame(genes, "win_id long, start0 long, end0 long, feature string, gene_name string, gene_id string")
    got = {(r.win_id, r.gene_id): r.lane for r in intervals.annotation_lanes(df).collect()}
    for win in (0, 1):
        own = sorted((r for r in genes if r[0] == win), key=lambda r: (r[1], r[2], r[4] is not None, r[4] or "", r[5]))
        last, lane = None, 0
        for r in own:
            lane += last is None or r[3] == "gene" or (r[4] is not None and last != r[4])
            last = r[4]
            assert got[win, r[5]] == lane
    assert intervals.annotation_lanes(df.limit(0)).count() == 0


def test_tracks_are_aligned_by_one_join(spark):
    schema = "row_id long, bin_idx int, context string, ref_signal double, extra string"
    ref = spark.createDataFrame([(1, 0, "a", 1.0, "r"), (1, 1, "a", None, "r"), (1, 1, None, 5.0, "r"), (2, 0, "a", 3.0, "r")], schema)
    alt = spark.createDataFrame([(1, 0, "a", 2.0, "q"), (1, 1, "a", 4.0, None), (1, 1, None, 5.0, "q"), (3, 0, "b", 3.0, "q")], schema.replace("ref_signal", "alt_signal"))
    both, lone = tracks.align_tracks(ref, alt)
    assert rows(both, "row_id", "bin_idx", "ref_signal", "alt_signal", "extra", "alt_extra") == [(1, 0, 1.0, 2.0, "r", "q"), (1, 1, None, 4.0, "r", None)]
    assert lone.first()[0] == 4
    assert tracks.align_tracks(ref.limit(0), alt)[1].first()[0] == 4


def test_head_meets_contexts_once(spark):
    """Pairs of bins and contexts through the split first layer equal the head on each pair; nulls give null."""
    rng = np.random.default_rng(5)
    w = {"genome_w": rng.normal(size=(3, 4)), "genome_b": rng.normal(size=3), "layers": [(rng.normal(size=(5, 5)), rng.normal(size=5)), (rng.normal(size=(2, 5)), rng.normal(size=2))], "out_w": rng.normal(size=(1, 2)), "out_b": np.ones(1)}
    x, v = rng.normal(size=(7, 4)), rng.normal(size=(3, 2))
    for options in ({}, {"layer_norm": True}, {"activation": "relu", "relu_out": False}):
        for weights in (w, w | {"layers": [], "out_w": rng.normal(size=(1, 5))}):
            head = inference.head_predictor(weights, **options)
            want = head(np.repeat(x, 3, axis=0), np.tile(v, (7, 1))).reshape(7, 3)
            for cells in (1, 20, 1 << 20):
                assert np.allclose(head.pairs(x, v, cells), want)
    bins = spark.createDataFrame([(r, b, [float(z) for z in x[r]], None if r == 2 else [float(z) for z in x[b]]) for r in range(4) for b in range(3)], "row_id long, bin_idx int, ref_features array<double>, alt_features array<double>")
    ctx = spark.createDataFrame([(i, f"c{i}", [float(z) for z in v[i]]) for i in range(3)], "context_id long, context string, vector array<double>")
    made = {(r.row_id, r.context_id): r.effect for r in inference.predict_effects(bins.repartition(3), ctx, inference.head_block(w), "sum_diff").collect()}
    head = inference.head_predictor(w)
    for r in range(4):
        for c in range(3):
            want = None if r == 2 else sum(float(head(x[b : b + 1], v[c : c + 1])[0, 0] - head(x[r : r + 1], v[c : c + 1])[0, 0]) for b in range(3))
            assert (made[r, c] is None) == (want is None) and (want is None or abs(made[r, c] - want) < 1e-9)
    for width, held in ((2, 2), (2, 4), (8, 8)):
        table = inference.predict_blocks(bins.repartition(5), ctx, inference.head_block(w), "sum_diff", width, held)
        long = blocks.from_blocks(table, ctx, width=width)
        assert {(r.row_id, r.context_id): round(r.effect, 9) for r in long.collect()} == {k: round(e, 9) for k, e in made.items() if e is not None}


def test_predict_makes_no_cross_join(spark):
    bins = spark.createDataFrame([(1, "c", 0, 0, 4, "GGCC", "AAAA")] * 3, "row_id long, chrom string, bin_idx int, bin_start long, bin_end long, ref_bin string, alt_bin string")
    ctx = spark.createDataFrame([(i, f"x{i}") for i in range(5)], "context_id long, context string")
    made = inference.predict(bins, ctx, inference.gc_predictor, block=2, held=4, lines=3)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert made.count() == 15 and inference.predict(bins.limit(0), ctx, inference.gc_predictor).count() == 0
    assert inference.predict(bins, ctx.limit(0), inference.gc_predictor).count() == 0


def test_blocks(spark, tmp_path):
    """Blocks hold what long rows hold: nulls, repeated cells, unknown contexts, gaps; kernels equal the long ones."""
    ctx = spark.createDataFrame([(i * 3, f"k{i % 4}---a{i // 4} RNA-seq" if i // 4 else f"k{i % 4}---b", f"k{i % 4}", f"a{i // 4} RNA-seq" if i // 4 else "b") for i in range(11)], "context_id long, context string, celltype string, assay string")
    names = [(r.context_id, r.context) for r in ctx.orderBy("context_id").collect()]
    data = [(row, name, ((row * 31 + i * 7) % 19 - 9) / 8 if (row + i) % 5 else None) for row in range(60) for i, (_, name) in enumerate(names) if (row * i) % 7 != 3]
    long = spark.createDataFrame(data + [(0, names[0][1], -99.0), (0, "unknown", 1.0), (7, None, 1.0)], "row_id long, context string, effect double")
    kept = sorted((r, n, e) for r, n, e in data if e is not None)
    if not any(d[:2] == (0, names[0][1]) and d[2] is not None for d in data):
        kept = sorted([*kept, (0, names[0][1], -99.0)])
    for width in (1, 4, 64):
        table = blocks.to_blocks(long, ctx, width=width)
        assert sorted(map(tuple, blocks.from_blocks(table, ctx, width=width).select("row_id", "context", "effect").collect())) == kept
        path = blocks.write_blocks(table, ctx, str(tmp_path / f"m{width}"), "x", width)
        again = blocks.read_blocks(spark, path, ctx, 3)
        assert sorted(map(tuple, blocks.from_blocks(again, ctx, width=3).select("row_id", "context", "effect").collect())) == kept
        plain = spark.createDataFrame(kept, "row_id long, context string, effect double").join(ctx, "context")
        want = {(r.row_id, r.context): round(r.normed, 9) for r in scoring.normalise_effects(plain).collect()}
        got = blocks.from_blocks(blocks.normalise_blocks(table, ctx, width=width), ctx, value="normed", width=width)
        assert {(r.row_id, r.context): round(r.normed, 9) for r in got.collect()} == want
        assert blocks.to_blocks(long.limit(0), ctx, width=width).count() == 0
    narrow = ctx.filter("context_id < 9")  # a catalogue without some of the file's columns, and one with more
    assert blocks.from_blocks(blocks.read_blocks(spark, path, narrow, 2), narrow, width=2).count() == sum(n in {c for i, c in names if i < 9} for _, n, _ in kept)
    wide = ctx.unionByName(spark.createDataFrame([(1, "new", "n", "e")], ctx.schema))
    assert sorted(map(tuple, blocks.from_blocks(blocks.read_blocks(spark, path, wide, 4), wide, width=4).select("row_id", "context", "effect").collect())) == kept


def test_background_of_a_hot_locus_in_blocks(spark):
    """Merged moments equal those of long rows, for any parts, also far from zero; places without values are null."""
    ctx = spark.createDataFrame([(i, f"c{i}") for i in range(5)], "context_id long, context string")
    data = [(r, 0 if r % 9 else r, f"c{c}", 1e6 + (r * 37 + c) % 11 / 7 * (-1) ** (r % 2 * c)) for r in range(900) for c in range(4) if (r + c) % 6]
    long = spark.createDataFrame(data, "row_id long, locus_id long, context string, effect double").repartition(6)
    table = blocks.to_blocks(long, ctx, ("row_id", "locus_id"), width=2)
    made = blocks.background_blocks(table, parts=3, groups=2)
    got = {(r.locus_id, r.block * 2 + i): (n, m, s, e) for r in made.collect() for i, (n, m, s, e) in enumerate(zip(r.bg_n, r.bg_mean, r.bg_std, r.bg_signed))}
    groups: dict = {}
    for _, locus, c, e in data:
        groups.setdefault((locus, int(c[1:])), []).append(e)
    assert {k for k, v in got.items() if v[0]} == set(groups)
    for k, xs in groups.items():
        n, mean, std, signed = got[k]
        assert n == len(xs) and abs(mean - np.mean(np.abs(xs))) < 1e-6 and abs(std - np.std(np.abs(xs))) < 1e-7 and abs(signed - np.mean(xs)) < 1e-6
    assert all(v == (0, None, None, None) for k, v in got.items() if k not in groups)
    assert blocks.background_blocks(table.limit(0)).count() == 0
