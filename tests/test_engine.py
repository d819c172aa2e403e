"""Goldens and properties of the relational-hypergraph operators."""

import math
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.config import ClusteringConfig, ExperimentConfig, WalkConfig
from hyperloom.errors import ArgumentRangeError, ArgumentTypeError, AtomSyntaxError
from hyperloom.functions import stats
from hyperloom.functions.stats import chi2_sum_upper, t_upper, theta_sym
from hyperloom.operators import communities, diagnostics, etl, graph, grouping, mln, spectral, walks
from hyperloom.operators.hypergraph import Hypergraph
from hyperloom.plans import shared
from hyperloom.plans.shared import cut
from hyperloom.sources import text, writer
from hyperloom.streaming import feed

#: A small social network: friends both ways, smokers, patients.
FRIENDS = "Anna-Bob Anna-Edward Anna-Frank Bob-Chris Chris-Daniel Edward-Frank Gary-Helen Gary-Anna".split()
LINES = [f"Friends({p[i]}, {p[1 - i]})" for f in FRIENDS for p in [f.split("-")] for i in (0, 1)]
LINES += [f"Smokes({n})" for n in ("Anna", "Edward", "Frank", "Gary")] + [f"Cancer({n})" for n in ("Anna", "Edward")]
INFO = ["Friends(person, person)", "Smokes(person)", "Cancer(person)"]


def _lines(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, value string").select("value", "line_no")


@pytest.fixture(scope="module")
def social(spark):
    atoms = text.parse_atoms(_lines(spark, ["// a comment", "", *LINES])).drop("_corrupt")
    return Hypergraph(cut(atoms), text.parse_info(_lines(spark, INFO)))


def test_structure(social):
    c = social.counts().first()
    assert (c.n_nodes, c.n_edges, c.n_predicates, c.n_types) == (8, 22, 1, 1)
    g = social.clique_graph()
    assert g.count() == 8 and g.agg(F.sum("weight")).first()[0] == 16 and social.is_connected()
    assert graph.two_sweep(g).first().diameter == 5
    assert graph.connected_components(g).select("component").distinct().count() == 1


def test_grammar(spark):
    good = ["P(a)", "P-q(a, b,c)", "Größe(é')", "  P(a,  b)  "]
    bad = ["P", "P()", "P (a)", "P(a ,b)", "P(a;b)"]
    v = F.col("value")
    assert _lines(spark, good).filter(text.is_atom(v)).count() == len(good)
    assert _lines(spark, bad).filter(text.is_atom(v)).count() == 0
    with pytest.raises(AtomSyntaxError):
        text.parse_atoms(_lines(spark, ["P(a)", "P"])).collect()
    assert text.parse_atoms(_lines(spark, ["P(a)", "P"]), "PERMISSIVE").filter("_corrupt is not null").count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.db").write_text("\n".join(LINES) + "\n")
    (tmp_path / "a.info").write_text("\n".join(INFO) + "\n")
    atoms, info = text.scan_hypergraph(spark, str(tmp_path / "a.db"), str(tmp_path / "a.info"))
    assert [r.edge_id for r in atoms.orderBy("edge_id").collect()] == list(range(22)) and info.count() == 3
    with pytest.raises(ValueError):
        text.scan_hypergraph(spark, str(tmp_path / "a.db"))


def test_spectral_goldens(social):
    g = social.clique_graph()
    r = spectral.second_eigenvalues(g).first()
    assert abs(r.lambda2 - 0.169530) < 1e-6 and abs(r.phi - 0.2) < 1e-6 and sorted((r.n_first, r.n_second)) == [3, 5]
    c = spectral.hierarchical_clusters(g, ClusteringConfig(3, 0.7)).groupBy("cluster").count().collect()
    assert sorted(x["count"] for x in c) == [3, 5]


def _row_of_cliques(spark, cliques, size):
    """Cliques joined one after another by single edges, and a loop."""
    rows = [(f"n{c:02d}_{i:02d}", f"n{c:02d}_{j:02d}", 1 + (i + j + c) % 3) for c in range(cliques) for i in range(size) for j in range(i + 1, size)]
    rows += [(f"n{c:02d}_00", f"n{c + 1:02d}_01", 1 + c % 2) for c in range(cliques - 1)] + [("n00_02", "n00_02", 2)]
    return spark.createDataFrame(rows, "src string, dst string, weight long")


def test_spectral_on_tables_equals_dense(spark, social, monkeypatch):
    from hyperloom.operators import spectral as S

    both = social.clique_graph().withColumn("path", F.lit("0")).unionByName(_row_of_cliques(spark, 3, 5).withColumn("path", F.lit("1")))
    both = cut(both)
    dense = {(r.path, r.node): r for r in S.bisect(both, ClusteringConfig()).collect()}
    clusters = sorted(sorted(x.n) for x in S.hierarchical_clusters(social.clique_graph(), ClusteringConfig(3, 0.7)).groupBy("cluster").agg(F.collect_list("node").alias("n")).collect())
    monkeypatch.setattr(S, "DENSE", 6)
    tables = {(r.path, r.node): r for r in S.bisect(both, ClusteringConfig()).collect()}  # both clusters in the same rounds
    assert {n: r.side for n, r in tables.items()} == {n: r.side for n, r in dense.items()}
    assert all(abs(r.lambda2 - dense[n].lambda2) < 1e-6 and abs(r.phi - dense[n].phi) < 1e-9 and r.n == dense[n].n for n, r in tables.items())
    assert sorted(sorted(x.n) for x in S.hierarchical_clusters(social.clique_graph(), ClusteringConfig(3, 0.7)).groupBy("cluster").agg(F.collect_list("node").alias("n")).collect()) == clusters
    monkeypatch.setattr(S, "DENSE", 4), monkeypatch.setattr(S, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        S.bisect(both, ClusteringConfig())


def test_running_sums_by_blocks(spark):
    rows = [(g, i, (7 * i + 3) % 11 - 4) for g, n in (("a", 40), ("b", 1), ("c", 16)) for i in range(n)]
    got = shared.running_sums(spark.createDataFrame(rows, "g string, i long, v long"), "g", "i", ["v"], block=4).collect()
    assert {(r.g, r.i): r.v for r in got} == {(g, i): sum(v for h, j, v in rows if h == g and j <= i) for g, i, _ in rows}


def test_exact_times(spark, social):
    others = ["Bob", "Edward", "Frank", "Chris", "Helen", "Gary", "Daniel"]
    pairs = spark.createDataFrame([("Anna", o) for o in others], "source string, target string")
    got = {r.target: r.tht for r in walks.exact_times(walks.exact_hits(social, pairs, 5), 5).collect()}
    want = {"Bob": 3.78125, "Edward": 3.390625, "Frank": 3.390625, "Chris": 4.5625, "Helen": 4.5625, "Gary": 3.78125, "Daniel": 4.875}
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_sampled_times_and_communities(spark, social):
    config = WalkConfig(epsilon=0.1, max_path_length=5)
    sources = spark.createDataFrame([("Anna",)], "source string")
    hits, n = walks.sample(social, sources, config, 5, n_predicates=1)
    times = {r.node: r.avg_tht for r in walks.hitting_times(hits, n, 5).collect()}
    assert abs(times["Bob"] - 3.78125) < 0.25 and all(0 < t <= 5 for t in times.values())
    found = communities.communities(social, config, 5, sources)
    rows = found.collect()
    assert rows and len({r.node for r in rows}) == len(rows) <= 8
    ids = social.node_ids()
    numbers = writer.community_numbers(found, ids)
    block = writer.atom_blocks(writer.atom_lines(social, found, ids), numbers).first().block
    assert block.startswith("#START_DB 0 #COM 1 #NUM_ATOMS ") and block.endswith("#END_DB\n\n")


def test_communities_inside_clusters(spark, social):
    clusters = cut(spectral.hierarchical_clusters(social.clique_graph(), ClusteringConfig(3, 0.7)))
    found = communities.clustered_communities(social, clusters, WalkConfig(epsilon=0.3)).collect()
    of = {r.node: r.cluster for r in clusters.collect()}
    assert {(r.cluster, r.source) for r in found} == {(c, n) for n, c in of.items()}  # border nodes are no sources
    assert all(r.cluster == of[r.source] for r in found) and {r.node for r in found if r.role == "SOURCE"} == set(of)
    lengths = {r.cluster: r.length for r in found}
    for c, n in lengths.items():
        inside = Hypergraph(social.leaf(clusters).filter(F.col("cluster") == c).drop("cluster"), social.predicates).clique_graph()
        assert n == graph.two_sweep(inside).first().diameter + 1


def test_quantiles_hold_their_level():
    """Samples of one distribution are told apart about as often as alpha says, those of others nearly always."""
    rng = np.random.default_rng(4)
    p, n, alpha = np.array([0.4, 0.3, 0.2, 0.1]), 3000, 0.1
    apart = lambda q: np.mean([not _passes(rng.multinomial(n, p, 4).tolist() + rng.multinomial(n, q, 1).tolist(), n, alpha) for _ in range(300)])
    assert 0.04 < apart(p) < 0.18 and apart(np.array([0.3, 0.3, 0.2, 0.2])) > 0.95

    def far(q):
        out = []
        for _ in range(300):
            a, b = (dict(enumerate(rng.multinomial(n, x) / n)) for x in (p, q))
            d, m = grouping.sk_of(a, b)
            out.append(d >= grouping.sk_threshold(m, 4, n, alpha))
        return np.mean(out)

    assert far(p) <= alpha and far(np.array([0.2, 0.2, 0.3, 0.3])) > 0.95


def _passes(counts, n, alpha) -> bool:
    c = np.array(counts, float).T[:3]  # the last path is left to the null row
    full = np.vstack([c, n - c.sum(0)])
    return ((full - full.mean(1, keepdims=True)) ** 2).sum() <= grouping.critical_value(full, n, alpha)


def test_budgets():
    for (n, length, eps), (tht, p, path, one) in {(1, 5, 0.1): (400, 6, 717, 179), (4, 5, 0.1): (400, 1365, 2888, 722), (4, 7, 0.1): (900, 21845, 3997, 999), (1, 7, 0.1): (900, 8, 832, 225)}.items():
        assert walks.budget(WalkConfig(epsilon=eps, max_path_length=length), n, length) == {"tht": tht, "p_star": p, "path": path, "phase_1": one}


def test_quantiles():
    assert abs(t_upper(0.1, 1) - 3.077684) < 1e-5 and abs(t_upper(0.1, 2) - 1.885618) < 1e-5
    assert abs(theta_sym(5, 717, 0.1) - 0.13549) < 1e-4


@pytest.mark.parametrize("alpha", [0.9, 0.1, 0.05, 0.01, 0.001])
def test_weighted_chi_squared_quantiles(alpha):
    tail = {1: lambda q: math.erfc(math.sqrt(q / 2)), 2: lambda q: math.exp(-q / 2), 5: lambda q: math.erfc(math.sqrt(q / 2)) + math.sqrt(2 * q / math.pi) * math.exp(-q / 2) * (1 + q / 3)}
    for dof, f in tail.items():
        assert abs(f(chi2_sum_upper(alpha, [1.0] * dof, [1] * dof)) - alpha) < 1e-6 * alpha
        assert abs(f(chi2_sum_upper(alpha, [3.0, 0.0], [dof, 7]) / 3) - alpha) < 1e-6 * alpha
    for n in (10, 100, 398, 402, 5000):  # even degrees of freedom: a Poisson sum; on both sides of the change of method
        q = chi2_sum_upper(alpha, [0.5, 0.5], [n - 2, 2])
        assert abs(sum(math.exp(-q + i * math.log(q) - math.lgamma(i + 1)) for i in range(n // 2)) - alpha) < 1e-6 * alpha
    q = chi2_sum_upper(alpha, [2.0, 1.0], [2, 2])
    assert abs(2 * math.exp(-q / 4) - math.exp(-q / 2) - alpha) < 1e-6 * alpha
    for w, d in (([1, 1e-4], [1, 1000]), ([1, 0.3, 0.01], [3, 30, 2])):  # two methods agree
        q = chi2_sum_upper(alpha, w, d)
        assert abs(stats._line(q, np.array(w, float), np.array(d, float))[0] - alpha) < 1e-6 * alpha


def test_divergences(spark):
    p1, q1 = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.7, "b": 0.2, "c": 0.1}
    q2, q3, q4 = {**q1, "d": 0}, {"d": 0.1, "a": 0.7, "b": 0.1, "c": 0.1}, {"a": 0.6, "b": 0.2, "c": 0.15, "d": 0.05}
    df = lambda d: spark.createDataFrame([("x", k, float(v)) for k, v in d.items()], "pair string, key string, p double")
    for p, q, want in ((p1, q1, 0.09203285023), (p1, q2, 0.09203285023), (q2, q3, 0.13862943611), (q1, q3, 0.13862943611), (q3, q4, 0.06735896506)):
        assert abs(grouping.kl_divergence(df(p), df(q)).first().kl - want) < 1e-9
    assert abs(grouping.sk_of(p1, q3)[0] - 0.0776870668) < 1e-9
    assert abs(grouping.sk_divergence(df(p1), df(q3)).first().sk - 0.0776870668) < 1e-9


def test_symmetry_kernels():
    same = {"a": {"P,": 50, "P,P,": 20}, "b": {"P,": 52, "P,P,": 19}, "c": {"P,": 49, "P,P,": 21}}
    assert grouping.is_symmetric(same, 200, 3, 2, 0.05)
    apart = {**same, "d": {"Q,": 90, "Q,Q,": 60}}
    assert not grouping.is_symmetric(apart, 200, 3, 2, 0.05)
    assert ["d"] in [sorted(g) for g in grouping.merge_by_divergence(apart, 200, 3, 0.05)]
    labels = grouping.ward(np.array([[0.0, 0], [0.01, 0], [5, 5], [5.2, 5]]), 2)
    assert labels[0] == labels[1] != labels[2] == labels[3]


def test_config():
    with pytest.raises(ArgumentRangeError):
        ClusteringConfig(2, 0.7)
    with pytest.raises(ArgumentTypeError):
        WalkConfig(epsilon="x")
    with pytest.raises(ArgumentRangeError):
        WalkConfig(alpha_sym=0.5)


def test_formulas(spark):
    r = mln.formula_stats(text.parse_rules(spark.createDataFrame([("// 1  a v b",), ("0.5  A(x) v B(x)",), ("-1.2  C(x)",), ("",)], "value string"))).first()
    assert (r.avg_length, r.max_length, r.n_formulas) == (1.5, 2, 2)
    assert mln.formula_stats(text.parse_rules(spark.createDataFrame([], "value string"))).first().n_formulas == -1
    rows = [("d", "A", 0.9, True, 0), ("d", "A", 0.1, True, 1), ("d", "B", 0.2, False, 2)]
    got = mln.cll(spark.createDataFrame(rows, "db string, ground_atom string, prob double, positive boolean, line_no int"), ["db"]).first()
    assert abs(got.cll - math.log((0.9 + 0.9 + 0.8) / 3)) < 1e-9


def _brute_ward(c):
    groups, out = [[i] for i in range(len(c))], []
    while len(groups) > 1:
        grow = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((c[a].mean(0) - c[b].mean(0)) ** 2).sum()
        _, i, j = min((round(grow(groups[i], groups[j]), 12), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        groups[i] = groups[i] + groups[j]
        del groups[j]
        out.append(sorted(sorted(g) for g in groups))
    return out


@pytest.mark.parametrize("n", [2, 3, 12, 30])
def test_ward_tree_equals_brute_force(n):
    c = np.random.default_rng(n).normal(size=(n, 2))
    rows, now, got = {i: [i] for i in range(n)}, set(range(n)), []
    for t, (a, b) in enumerate(grouping.ward_tree(c)):
        rows[n + t] = rows[a] + rows[b]
        now = now - {a, b} | {n + t}
        got.append(sorted(sorted(rows[x]) for x in now))
    assert got == _brute_ward(c)
    for k in range(2, n + 1):
        labels = grouping.ward(c, k, threshold=1e-9)
        assert sorted(sorted(np.flatnonzero(labels == y).tolist()) for y in set(labels)) == (got[n - k - 1] if k < n else [[i] for i in range(n)])


def test_subclusters_keep_their_radius_and_their_number():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(400, 2)) * 0.01 + o for o in rng.normal(size=(9, 2)) * 3])
    for most in (2000, 5):
        found = grouping.subclusters(x, most=most)
        assert sorted(i for rows in found for i in rows) == list(range(len(x))) and len(found) <= most
        radius = [float(np.sqrt(((x[r] - x[r].mean(0)) ** 2).sum(1).mean())) for r in found]
        assert most == 5 or max(radius) <= grouping.THRESHOLD + 1e-9


def test_experiment_runs_times_and_logs(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    for d in ("a.db", "b.db", "c.db"):
        (data / d).write_text("Smokes(x)\n")
    (data / "t.info").write_text("// no\nFriends(p, p)\nSmokes(p)\n")
    f = mln.Folders(str(data), str(tmp_path), str(tmp_path), str(tmp_path), str(tmp_path / "log"))
    done = []

    def run(command, timeout):
        done.append(command)
        if command[0] == "own" and "b.db" in command[1]:
            raise subprocess.TimeoutExpired(command, timeout)
        if "-g" in command:
            open(command[command.index("-o") + 1], "w").write("// rules\n1.5  A(x) v B(x)\n-2  C(x)\n")
        if command[0] == "infer":
            open(command[command.index("-r") + 1], "w").write("Smokes(x) 0.8\nSmokes(y) 0.6\n")

    x = mln.Experiment(ExperimentConfig(("a.db", "b.db", "c.db"), number_of_tests=2), f, "t.info", "t.type", mln.Programs(own="own"), run)
    dry = x.commands("Friends,Smokes")
    got = x.execute(spark)
    assert done == dry and len(dry) == 3 + 2 * 4 + 3 + 2 * 4 + 2 * 2 * 2
    here, there = str(data), str(tmp_path)
    out = f"{there}/a_rwl"
    assert dry[0] == ["rwl", f"{here}/t.info", f"{here}/a.db", f"{here}/t.type", "10000", "5", "0.05", "0.1", "4.9", "0.1", "1", "3", "1", f"{out}.ldb", f"{out}.uldb", f"{out}.srcnclusts"]
    assert dry[11] == ["own", f"{here}/a.db", f"{here}/t.info", f"{there}/a_hl", "0.1", "0.001", "1", "0.8", "10"]
    combined, others = f"{there}/NOTa_rwl.comb.ldb", lambda s: f"{there}/b_rwl{s},{there}/c_rwl{s}"
    assert dry[3:7] == [
        ["getcom", others(".ldb"), others(".uldb"), others(".srcnclusts"), f"{here}/t.info", "10", combined, "NOOP", "true", "1"],
        ["pfind", combined, "5", "0", "5", "-1.0", f"{here}/t.info", f"{there}/NOTa_rwl.rules"],
        ["createrules", f"{there}/NOTa_rwl.rules", "0", f"{here}/b.db,{here}/c.db", combined, others(".uldb"), f"{here}/t.info", "learnwts", "tmpdir", "0.5", "0.1", "0.1", "100", "5", "100", "1000", "5", f"{there}/NOTa_rwl-rules.mln", "1", "-", "-", "true", "false", "40"],
        ["learnwts", "-g", "-i", f"{there}/NOTa_rwl-rules.mln", "-o", f"{there}/NOTa_rwl-rules-out.mln", "-t", f"{here}/b.db,{here}/c.db"],
    ]
    assert dry[-1] == ["infer", "-i", f"{there}/NOTb_hl-rules-out.mln", "-r", f"{there}/NOTb_hl.b.results.negative", "-e", f"{here}/b.db", "-q", "Friends,Smokes", "-maxSteps", "300"]
    assert dry[-2][-2:] == ["-queryEvidence", "1"] and ".positive" in dry[-2][4]
    assert [(r["method"], r["test"], r["n_formulas"], r["avg_length"]) for r in got] == [(m, d, 2, 1.5) for m in ("baseline", "hyperloom") for d in ("a.db", "b.db")]
    assert all(abs(r["cll"] - math.log((0.8 + 0.6 + 0.2 + 0.4) / 4)) < 1e-12 for r in got)
    lines = lambda n: (tmp_path / f"log_{n}").read_text().splitlines()
    assert len(lines("baseline_motif_time")) == 4 and "+/-" in lines("baseline_motif_time")[-1]
    assert lines("hyperloom_errors") == ["b.db, motif finding on this database took more than 5.0s"]
    assert [x.split(",")[0] for x in lines("hyperloom_structure_learning_time")] == ["all others MLN on a.db", "all others MLN on b.db", "average all others MLN on leave one out"]
    assert lines("baseline_mln_statistics")[0] == "NOTa.db, #formulas 2 avg formula length 1.5 max formula length 2"
    done.clear()
    alone = mln.Experiment(ExperimentConfig(("a.db", "b.db"), only="hyperloom", individual_query_predicates=True), f, "t.info", "t.type", mln.Programs(), run, motifs=lambda *a: done.append(list(a)))
    assert len(alone.execute(spark)) == 1 and done[0][:3] == [f"{here}/a.db", f"{here}/t.info", f"{there}/a_hl"]
    assert sum(c[0] == "infer" for c in done) == 4
    for n in ("a_hl.ldb", "x_tmpalchemy.mln"):
        (tmp_path / n).write_text("")
    assert x.clean(generated=True)[-1] == "a_hl.ldb"
    with pytest.raises(ValueError):
        mln.suffix("other")


def test_imports_stand_alone():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_communities_of_every_node(spark):
    from hyperloom import catalog

    sf = "/root/testdata/sf0.001"
    nodes = {r.node for r in catalog._hg(spark, sf, False).incidence.select("node").distinct().collect()}
    for name in ("communities", "communities_legacy"):
        assert {r.source for r in catalog.QUERIES[name](spark, sf).select("source").distinct().collect()} == nodes


def test_ratings_folder_to_database(spark, tmp_path):
    (tmp_path / "movies.dat").write_bytes("1::Toy (1995)::Animation|Comedy\n2::Amélie::Comedy\n5000::Late::Drama\n".encode("latin-1"))
    (tmp_path / "users.dat").write_text("1::F::1::10::48067\n2::M::56::16::70072\n3::X::99::1::1\n")
    (tmp_path / "ratings.dat").write_text("1::1::5::978300760\n2::2::3::978302109\n2::1::1::978301968\n")
    tables = text.read_ratings(spark, str(tmp_path))
    got = {(r.section, r.atom) for r in etl.rating_database(tables).collect()}
    assert got == {(0, "Animation(M1)"), (0, "Comedy(M1)"), (0, "Comedy(M2)"), (1, "Female(U1)"), (1, "Youthful(U1)"), (1, "Male(U2)"), (1, "Old(U2)"), (2, "Positive(U1,M1)"), (2, "Indifferent(U2,M2)"), (2, "Negative(U2,M1)")}
    assert (0, "Drama(M5000)") in {(r.section, r.atom) for r in etl.rating_database(tables, None).collect()}
    assert tables["movies"].filter("MovieID = 2").first()[1] == "Amélie"


def test_files_of_communities_and_logs(spark, social, tmp_path):
    found = spark.createDataFrame([("Anna", "Anna", "SOURCE", None), ("Anna", "Bob", "SINGLE", None), ("Anna", "Edward", "CLUSTER", 0), ("Anna", "Frank", "CLUSTER", 0)], "source string, node string, role string, cluster_id long")
    everyone = found.unionByName(social.incidence.select("node").distinct().filter("node <> 'Anna'").select(F.col("node").alias("source"), "node", F.lit("SOURCE").alias("role"), F.lit(None).cast("long").alias("cluster_id")))
    writer.write_files(social, everyone, str(tmp_path / "out"))
    for suffix in (".ldb", ".uldb", ".srcnclusts"):
        mln.join_parts(str(tmp_path / f"out{suffix}"), str(tmp_path / f"whole{suffix}"))
    lines = (tmp_path / "whole.ldb").read_text().splitlines()
    assert lines[0] == "#START_GRAPH  #COMS 8" and lines[-1] == "#END_GRAPH" and lines.count("#END_DB") == 8
    assert any(x.startswith("Friends(NODE_0,CLUST_0") or x.startswith("Friends(CLUST_0,NODE_0") for x in lines)
    assert "CLUST" not in (tmp_path / "whole.uldb").read_text() and "SRC  0" in (tmp_path / "whole.srcnclusts").read_text()
    metrics = spark.createDataFrame([("m", "time", "a.db", 1.5), ("m", "time", "b.db", 2.0)], "method string, quantity string, key string, value double")
    for _ in range(2):
        writer.append_log(metrics, str(tmp_path / "logs"))
    log = text.parse_log(text.read_lines(spark, str(tmp_path / "logs" / "method=m" / "quantity=time")))
    assert sorted((r.key, r.value) for r in log.collect()) == [("a.db", 1.5)] * 2 + [("b.db", 2.0)] * 2


def test_feed_keeps_the_graph_up_to_date(spark, social, tmp_path):
    rows = social.atoms.select("edge_id", "predicate", "args")
    rows.filter("edge_id % 2 = 0").write.parquet(str(tmp_path / "in"))
    for part in (0, 1):
        if part:
            rows.filter("edge_id % 2 = 1").write.mode("append").parquet(str(tmp_path / "in"))
        feed.follow(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(60)
    want = {(r.src, r.dst): r.weight for r in social.clique_graph().collect()}
    assert {(r.src, r.dst): r.weight for r in feed.current(spark, str(tmp_path / "out")).collect()} == want


def test_slots_of_any_arity(spark):
    wide = [f"n{i}" for i in range(10)]
    atoms = spark.createDataFrame([(0, "Wide", wide), (1, "Narrow", ["n9", "n3"])], "edge_id long, predicate string, args array<string>")
    info = spark.createDataFrame([("Wide", [f"t{i}" for i in range(10)]), ("Narrow", ["u0", "u1"])], "predicate string, arg_types array<string>")
    hg = Hypergraph(atoms, info)
    types = {r.node: r.node_type for r in hg.nodes.collect()}
    assert types["n9"] == "u0" and types["n3"] == "u1" and types["n8"] == "t8"
    assert {r.node: r.node_id for r in hg.node_ids().collect()} == {n: i for i, n in enumerate(wide)}


def test_grid_counts_leaves_as_the_clusterer_does(spark, social):
    g = cut(social.clique_graph())
    rows = {(r.min_cluster_size, r.max_lambda2): r for r in diagnostics.clustering_grid(g, [3, 4], [0.1, 0.7, 1.9]).collect()}
    assert len(rows) == 6
    for (m, lam), r in rows.items():
        sizes = [x["count"] for x in spectral.hierarchical_clusters(g, ClusteringConfig(m, lam)).groupBy("cluster").count().collect()]
        assert (r.n_clusters, r.largest) == (len(sizes), max(sizes)) and r.speedup >= 1
    assert diagnostics.grid_settings(8)[0] == [3, 4, 5, 6, 7] and len(diagnostics.grid_settings(99)[1]) == 19


def test_equal_groups_are_worked_out_once_in_a_task(spark):
    calls = []
    parts = grouping.parts_by_position(lambda c, n: calls.append(n) or grouping.merge_by_divergence(c, n, 2, 0.1, 1.0))
    one = {"a": {"P,": 2}, "b": {"P,": 1, "Q,": 1}, "c": {"P,": 2}}
    assert parts(one, 4) == grouping.merge_by_divergence(one, 4, 2, 0.1, 1.0)
    assert parts({k.upper(): v for k, v in one.items()}, 4) == [[n.upper() for n in g] for g in parts(one, 4)]
    assert calls == [4]
    rows = [(f"s{i}", "t", n, p, c) for i in range(50) for n, x in one.items() for p, c in x.items()] + [("s0", "u", "d", None, None)]
    found = grouping.each_group(spark.createDataFrame(rows, "source string, node_type string, node string, path string, cnt long"), ["source", "node_type"], lambda c: [(len(c), sum(map(len, c.values())))], "nodes long, paths long")
    assert {tuple(r) for r in found.collect()} == {(f"s{i}", "t", 3, 4) for i in range(50)} | {("s0", "u", 1, 0)}


def test_twins_are_contracted_before_the_rounds(spark, monkeypatch):
    from hyperloom.operators import spectral as S

    rows = [("0", f"h{h}", f"leaf{h}_{i:02}", 1) for h in range(3) for i in range(6 + h)] + [("0", "h0", "h1", 1), ("0", "h1", "h2", 1)]
    rows += [("1", "h", f"leaf{i:02}", 1) for i in range(9)]  # a star: eigenvalues 0, 1 and 2
    edges = cut(spark.createDataFrame(rows, "path string, src string, dst string, weight long"))
    dense = {(r.path, r.node): r for r in S.bisect(edges, ClusteringConfig()).collect()}
    table = {r.node: r for r in S.second_vectors(edges.filter("path = '1'")).collect()}
    scores = {r.node: r for r in S.second_of_twins(edges.filter("path = '1'")).collect()}
    sign = np.sign(table["leaf00"].score * scores["leaf00"].score)
    assert all(abs(r.lambda2 - 1) < 1e-9 and abs(r.score - sign * table[n].score) < 1e-4 for n, r in scores.items())
    monkeypatch.setattr(S, "DENSE", 7), monkeypatch.setattr(S, "second_vectors", None)
    found = {(r.path, r.node): r for r in S.bisect(edges, ClusteringConfig()).collect()}
    assert found.keys() == dense.keys() and all(abs(r.lambda2 - dense[k].lambda2) < 1e-9 and abs(r.phi - dense[k].phi) < 1e-9 for k, r in found.items())
    assert all(r.side == dense[k].side for k, r in found.items() if k[0] == "0")


def test_exact_walks_take_a_hubs_leaves_as_one_state(spark, monkeypatch):
    lines = [f"Lives(c{h}{i}, h{h})" for h in range(2) for i in range(30)] + ["In(h0, top)", "In(h1, top)", "Lives(c00, h1)"]
    hg = Hypergraph(cut(text.parse_atoms(_lines(spark, lines)).drop("_corrupt")), text.parse_info(_lines(spark, ["Lives(person, town)", "In(town, land)"])))
    pairs = spark.createDataFrame([("h0", "h1"), ("h1", "h0"), ("c01", "c05"), ("h0", "c07")], "source string, target string")
    sizes = []
    monkeypatch.setattr(walks, "cut", lambda df: [x := cut(df), sizes.append(x.count() if "path" in x.columns else 0)][0])
    own = {tuple(r)[:4]: r.p for r in walks.exact_hits(hg, pairs, 4, 1e-300).collect()}
    each, sizes[:] = max(sizes), []
    got = {tuple(r)[:4]: r.p for r in walks.exact_hits(hg, pairs, 4).collect()}
    assert got.keys() == own.keys() and all(abs(p - own[k]) < 1e-12 for k, p in got.items())
    assert each > 100 and max(sizes) < 40
