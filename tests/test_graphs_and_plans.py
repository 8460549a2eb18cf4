import gzip
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmat.operators import counts, filters, layouts, neighbors, tables
from quillmat.plans import expressions as ex
from quillmat.plans import jobs
from quillmat.sources import readers
from quillmat.streaming import running_sums
from tests.test_matrix import OBS, VARS, as_array, column, dense, matrix


def points(spark, n=60, dims=4, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, dims))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "obs_id long, x array<double>")


@pytest.mark.parametrize("block", [2048, 16])
def test_knn(spark, monkeypatch, block):
    monkeypatch.setattr(neighbors, "BLOCK", block)
    x, df = points(spark)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    edges = neighbors.knn(df.repartition(3), 5)
    got = {}
    for r in edges.collect():
        got.setdefault(r.obs_id, set()).add(r.nbr_id)
    assert all(got[i] == set(np.argsort(d[i])[:5].tolist()) for i in range(60))
    assert neighbors.knn(df.limit(3), 10).count() == 6
    far = spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(np.random.default_rng(1).normal(size=(40, 4)) + 50)] + [(2000 + i, [50.0] * 4) for i in range(30)], df.schema)
    both = df.union(far)
    every = {r.obs_id: np.array(r.x) for r in both.collect()}
    want = {a: {b for _, b in sorted((float(((every[a] - x) ** 2).sum()), b) for b, x in every.items() if b != a)[:7]} for a in every}
    met = {}
    for r in neighbors.knn(both.repartition(3), 7).collect():
        met.setdefault(r.obs_id, set()).add(r.nbr_id)
    assert met == want
    assert {(r.src, r.dst) for r in neighbors.adjacency(edges, symmetric=True).collect()} == {p for i in got for j in got[i] for p in ((i, j), (j, i))}
    assert neighbors.resolve_k(50, k_fraction=0.1) == 5
    with pytest.raises(ValueError):
        neighbors.resolve_k(50)


def test_outlier_factor(spark):
    x, df = points(spark)
    k = 4
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = np.argsort(d + np.eye(60) * 1e9, axis=1)[:, :k]
    kd = np.array([d[i, near[i]].max() for i in range(60)])
    lrd = np.array([k / np.maximum(kd[near[i]], d[i, near[i]]).sum() for i in range(60)])
    got = column(neighbors.local_outlier_factor(df, df, k=k), "obs_id", "LOF", range(60))
    assert np.allclose(got, [lrd[near[i]].mean() / lrd[i] for i in range(60)])
    new = spark.createDataFrame([(100, [9.0] * 4), (101, x[0].tolist())], df.schema)
    out = {r.obs_id: r.LOF for r in neighbors.local_outlier_factor(new, new, k=k, base=(df, df)).collect()}
    assert out[100] > 2 > out[101]


def test_transfer_and_layouts(spark):
    _, df = points(spark)
    labels = df.select("obs_id", F.when(F.col("x")[0] > 0, "hi").otherwise("lo").alias("label"))
    new = spark.createDataFrame([(7, [3.0, 0.0, 0.0, 0.0]), (8, [-3.0, 0.0, 0.0, 0.0])], df.schema)
    assert {r.obs_id: r.label for r in neighbors.transfer_annotation(df, labels, new, k=5).collect()} == {7: "hi", 8: "lo"}
    edges = neighbors.adjacency(neighbors.knn(df, 3), symmetric=True)
    one, two = ({r.obs_id: r.x for r in layouts.force_layout(df, edges, niter=20, dims=2).collect()} for _ in range(2))
    assert one == two and len(one) == 60
    y = neighbors.tsne(np.vstack([np.zeros((20, 3)), np.full((20, 3), 9.0)]) + np.random.default_rng(0).normal(size=(40, 3)) * 0.1, perplexity=5, max_iter=250)
    between = np.linalg.norm(y[:20].mean(0) - y[20:].mean(0))
    assert between > 2 * y[:20].std()
    two = np.vstack([np.zeros((20, 3)), np.full((20, 3), 9.0)]) + np.random.default_rng(0).normal(size=(40, 3)) * 0.1
    u = neighbors.umap(two, k=5, epochs=100)
    assert np.linalg.norm(u[:20].mean(0) - u[20:].mean(0)) > 2 * u[:20].std()
    added = neighbors.umap(two[:1] + 0.01, k=5, epochs=20, base=two, place=u)
    assert np.linalg.norm(added[0] - u[:20].mean(0)) < np.linalg.norm(added[0] - u[20:].mean(0))
    base = jobs.source(df)
    job = jobs.force_layout(base, k=3, k_projection=2, dims=2, niter=10)
    placed = {r.obs_id: r.x for r in job.fetch().collect()}
    moved = jobs.project(job, {base: jobs.source(df.limit(1).withColumn("obs_id", F.lit(500).cast("long")))}).fetch().first()
    assert np.allclose(moved.x, placed[df.first().obs_id], atol=1e-6)


def leaf(spark, m, name):
    t = spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(m) if v], "i long, j long, value double")
    return ex.Leaf(t, *m.shape, float((m != 0).mean()), name)


def to_array(t, shape):
    out = np.zeros(shape)
    for r in t.collect():
        out[r["i"], r["j"]] = r["value"]
    return out


def test_expressions(spark):
    rng = np.random.default_rng(4)
    a, b, c = (rng.integers(0, 3, s) for s in ((3, 4), (4, 2), (2, 5)))
    x, y, z = (leaf(spark, m, n) for m, n in ((a, "A"), (b, "B"), (c, "C")))
    p = ex.product(x, ex.product(y, z))
    assert repr(ex.total(p, p)) == "ABC+ABC" and repr(ex.transpose(p)) == "C'B'A'"
    assert np.array_equal(to_array(ex.compute(p, spark), (3, 5)), a @ b @ c)
    assert np.array_equal(to_array(ex.compute(ex.transpose(p), spark), (5, 3)), (a @ b @ c).T)
    w = ex.Leaf(None, 3, 2, name="W", array=rng.normal(size=(3, 2)))
    s = ex.product(ex.total(ex.product(x, y), w), z)
    assert np.allclose(to_array(ex.compute(s, spark), (3, 5)), (a @ b + w.array) @ c)
    gram = {r.j: r.value for r in ex.diagonal_of_gram(s, spark).collect()}
    full = (a @ b + w.array) @ c
    assert all(gram.get(j, 0) == pytest.approx((full[:, j] ** 2).sum()) for j in range(5))
    with pytest.raises(ValueError):
        ex.product(x, x)


def test_best_order_against_all_orders():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = int(rng.integers(2, 6))
        dims = rng.integers(1, 50, n + 1)
        chain = [ex.Leaf(None, int(dims[i]), int(dims[i + 1]), float(rng.uniform(0.01, 1)), "ABCDE"[i]) for i in range(n)]

        def every(i, j):
            if i == j:
                yield 0.0, chain[i].fill
            for k in range(i, j):
                for (c1, f1), (c2, f2) in itertools.product(every(i, k), every(k + 1, j)):
                    own, fill = ex.work((dims[i], dims[k + 1], f1), (dims[k + 1], dims[j + 1], f2))
                    yield c1 + c2 + own, fill

        best = ex.best_order(chain)[0]
        # fills depend on the nesting, so the table's choice may miss the optimum, but never by much
        assert min(c for c, _ in every(0, n - 1)) <= best * (1 + 1e-9) <= 1.5 * min(c for c, _ in every(0, n - 1)) + 1e-9
        assert sorted(ex.show_order(chain).replace("(", "").replace(")", "").replace("·", "")) == sorted("ABCDE"[:n])


def test_restricted_expressions_and_hot_indices(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 3, (3, 4)), rng.integers(0, 3, (4, 5))
    x, y = leaf(spark, a, "A"), leaf(spark, b, "B")
    w = ex.Leaf(None, 5, 3, name="W", array=rng.normal(size=(5, 3)))
    rows, cols = spark.createDataFrame([(0,), (2,)], "i long"), spark.createDataFrame([(1,), (3,)], "j long")
    e = ex.total(ex.product(x, y), ex.transpose(w))
    want = a @ b + w.array.T
    want[1] = 0
    want[:, [0, 2, 4]] = 0
    assert np.allclose(to_array(ex.compute(ex.restrict(e, rows, cols), spark), (3, 5)), want)
    flipped = ex.restrict(ex.transpose(x), spark.createDataFrame([(1,)], "i long"), spark.createDataFrame([(0,)], "j long"))
    assert [(r.i, r.j, r.value) for r in flipped.cells(spark).collect()] == [(1, 0, a[0, 1])] * bool(a[0, 1])
    assert np.array_equal(to_array(ex.multiply(x.cells(spark), y.cells(spark), hot=2), (3, 5)), a @ b)


def test_products_and_sums_of_matrices(spark):
    from quillmat.operators import arithmetic, design

    m, d = dense(), matrix(spark)
    gram = arithmetic.matrix_product(d.transposed(), d)
    assert np.array_equal(as_array(gram.mat, OBS, OBS), m.T @ m)
    shuffled = d.with_obs(d.obs.withColumn("ord", -F.col("ord")))
    assert np.array_equal(as_array(arithmetic.matrix_product(shuffled, d.transposed()).mat, VARS, VARS), m @ m.T)
    c = design.normalize(d, "value")
    full = as_array(c.dense())
    assert np.allclose(as_array(arithmetic.matrix_product(c, d.transposed()).dense(), VARS, VARS), full @ m.T)
    assert np.allclose(as_array(arithmetic.matrix_product(d.transposed(), c).dense(), OBS, OBS), m.T @ full)
    assert np.allclose(as_array(arithmetic.matrix_sum(d, c, d).dense()), 2 * m + full)
    with pytest.raises(ValueError, match="differ"):
        arithmetic.matrix_product(d, d)
    with pytest.raises(ValueError, match="differ"):
        arithmetic.matrix_sum(d, filters.filter_var("id <> 'v1'", d))


def test_repulsion_against_all_pairs():
    rng = np.random.default_rng(8)
    for dims in (2, 3):
        for n in (2, 20, 80, 1500):
            x = rng.normal(size=(n, dims)) * rng.uniform(0.1, 5, dims)
            u = x[:, None] - x[None]
            want = (u / np.maximum((u**2).sum(2), 1e-2)[..., None]).sum(1)
            assert np.allclose(layouts.field(x, x, np.ones(len(x)), layouts.inverse, 0.0)[0], want)
            assert np.linalg.norm(layouts.field(x, x, np.ones(len(x)), layouts.inverse, 0.5)[0] - want) < 0.03 * np.linalg.norm(want) + 1e-9
    assert np.isfinite(layouts.field(np.zeros((50, 2)), np.zeros((50, 2)), np.ones(50), layouts.inverse, 0.7)[0]).all()


def test_projection(spark):
    m, d = dense(), matrix(spark)
    even, odd = (filters.filter_obs(f"ord % 2 = {k}", d) for k in (0, 1))
    base, new = jobs.source(even), jobs.source(odd)
    counted = jobs.obs_counts_sum(base, name="n")
    kept = jobs.filter_var(counted, where="n > 20")
    total = jobs.var_counts_sum(kept, name="total")
    again = jobs.project(total, {base: new})
    chosen = m[:, ::2].sum(1) > 20
    assert np.array_equal(column(again.fetch().obs, "id", "total", OBS[1::2]), m[chosen][:, 1::2].sum(0))
    # a replaced step below a frozen selection changes nothing in it; a replaced step itself does
    assert jobs.project(total, {}) is total and again.fingerprint() != total.fingerprint()
    norm = jobs.normalize_matrix(base)
    got = as_array(jobs.project(norm, {base: new}).fetch().dense(), VARS, OBS[1::2])
    assert np.allclose(got, m[:, 1::2] - m[:, ::2].mean(1, keepdims=True))
    few = jobs.source(filters.filter_var("id not in ('v0', 'v1')", odd))
    assert jobs.project(kept, {base: few}).fetch().var.count() == sum(chosen[2:])
    strict = jobs.filter_var(counted, where="n > 20", project_ids="yes")
    with pytest.raises(KeyError):
        jobs.project(strict, {base: few}).fetch()
    idf = jobs.project(jobs.tf_idf_transform(base), {base: new}).fetch()
    t = np.maximum(1, m[:, 1::2].sum(0))
    assert np.allclose(as_array(idf.mat, VARS, OBS[1::2]), np.log(1 + 10000 * m[:, 1::2] / t * (15 / np.maximum(1, m[:, ::2].sum(1)))[:, None]))
    assert jobs.cached(total).fetch().obs.count() == 15


def test_projection_replaces_equal_jobs_and_constants(spark, tmp_path):
    d = matrix(spark)
    even, odd = (filters.filter_obs(f"ord % 2 = {k}", d) for k in (0, 1))
    for name, x in (("even", even), ("odd", odd)):
        readers.save(x, str(tmp_path / name))
    paths = [str(tmp_path / n) for n in ("even", "odd")]
    # leaves of one file are equal jobs; the fingerprint of a folder is that of its path, size and time
    one, twin = (jobs.file_source(spark, paths[0], readers.load) for _ in range(2))
    assert one is not twin and one.fingerprint() == twin.fingerprint()
    job = jobs.var_counts_sum(jobs.log_transform(one), name="t")
    want = sorted(r.id for r in odd.obs.collect())
    assert sorted(r.id for r in jobs.project(job, {twin: jobs.source(odd)}).fetch().obs.collect()) == want
    assert sorted(r.id for r in jobs.project(job, {paths[0]: paths[1]}).fetch().obs.collect()) == want
    assert jobs.project(job, {"elsewhere": paths[1]}) is job
    # fields, and steps above them
    assert sorted(r.id for r in jobs.project(jobs.get_obs(job), {one: jobs.source(odd)}).fetch().collect()) == want
    small = jobs.step("is_small", lambda _, data: data.obs.count() < 16)
    either = jobs.ifelse(small(base_of := jobs.source(even)), jobs.get_obs(base_of), jobs.source(None, content="never"))
    assert either.fetch().count() == 15 and jobs.project(either, {base_of: jobs.source(odd)}).fetch().count() == 15
    # a frozen argument isn't replaced: selections come from the base, whatever happens to the job below
    base = jobs.source(even)
    kept = jobs.filter_var(jobs.obs_counts_sum(base, name="n"), where="n > 20")
    again = jobs.project(jobs.project(kept, {base: jobs.source(odd)}), {kept: jobs.source(d)})
    assert sorted(r.id for r in again.fetch().var.collect()) == sorted(r.id for r in kept.fetch().var.collect())
    same, other = jobs.source(filters.filter_obs("true", even)), jobs.source(filters.filter_var("id <> 'v3'", odd))
    second = jobs.var_at_positions(base, positions=[4, 1])
    assert [r.id for r in jobs.project(second, {base: same}).fetch().var.orderBy("ord").collect()] == ["v4", "v1"]
    with pytest.raises(ValueError, match="positions"):
        jobs.project(second, {base: other}).fetch()


def test_projection_freezes_fits(spark):
    m, d = dense(), matrix(spark)
    even, odd = (filters.filter_obs(f"ord % 2 = {k}", d) for k in (0, 1))
    base, new = jobs.source(even), jobs.source(odd)
    to_new = lambda j: jobs.project(j, {base: new}).fetch()
    centred = jobs.normalize_matrix(base)
    frozen = jobs.variance(centred, assume_centered=True)
    assert np.allclose(column(to_new(frozen).var, "id", "variance", VARS), m[:, ::2].var(1, ddof=1))
    fresh = jobs.variance(centred, assume_centered=True, project="yes")
    off = m[:, 1::2] - m[:, ::2].mean(1, keepdims=True)
    assert np.allclose(column(to_new(fresh).var, "id", "variance", VARS), (off**2).sum(1) / 14)
    beta = to_new(jobs.negative_regression(base))
    assert np.allclose(column(beta.select("var_id", F.col("b")[0].alias("b")), "var_id", "b", VARS), -m[:, ::2].mean(1))
    f = to_new(jobs.svd(centred, nsv=3, niter=3))
    u = np.array([{r.var_id: r.u for r in f.u.collect()}[x] for x in VARS])
    v = np.array([{r.obs_id: r.v for r in f.v.collect()}[x] for x in OBS[1::2]])
    assert np.allclose(v * f.s, off.T @ u, atol=1e-6)
    s = jobs.signature(base, where="kind = 'y'", niter=3)
    whole = {r.obs_id: r.x[0] for r in s.fetch().collect()}
    again = {r.obs_id: r.x[0] for r in jobs.project(s, {base: jobs.source(filters.filter_obs("true", even))}).fetch().collect()}
    assert whole.keys() == again.keys() and np.allclose([again[k] for k in whole], list(whole.values()), atol=1e-6)
    with pytest.raises(KeyError):
        jobs.project(s, {base: jobs.source(filters.filter_var("id <> 'v0'", odd))}).fetch()
    # labels and designs are the base's
    ab, bc = (jobs.source(filters.filter_obs(f"group <> '{g}'", d)) for g in "CA")
    ranks = jobs.project(jobs.mannwhitney(ab, column="group"), {ab: bc}).fetch()
    assert all(r.U == 0 for r in ranks.collect())  # nobody of A is left, and C isn't tested
    t = jobs.ttest(base, h1="value")
    v_new, scaled = np.sin(np.arange(30))[1::2] + 1, column(to_new(t), "var_id", "t", VARS)
    ok = [i for i in range(12) if m[i, 1::2].std() > 0]
    slope = np.array([np.corrcoef(v_new, m[i, 1::2])[0, 1] for i in ok])
    assert np.allclose(scaled[ok], slope * np.sqrt(13 / (1 - slope**2)), rtol=1e-6)
    with pytest.raises(ValueError):
        jobs.project(jobs.ftest(ab, h1=["group"]), {ab: bc}).fetch().collect()  # C is no category of the base
    totals = jobs.sctransform(base, min_cells=1)
    params = {r.id: (r.beta0, r.theta) for r in totals.fetch().var.collect()}
    assert {r.id: (r.beta0, r.theta) for r in to_new(totals).var.collect()} == params
    _, pts = points(spark, 40, 3)
    a = jobs.source(pts)
    moved = jobs.source(spark.createDataFrame([(100, [1.0, 0.0, 0.0]), (101, [0.0, 2.0, 0.0])], pts.schema))
    groups = pts.select("obs_id", (F.col("obs_id") % 2).alias("group"))
    turned = jobs.transform_coords(a, groups=groups, dims=3)
    q = np.array([r.x for r in jobs.project(turned, {a: moved}).fetch().orderBy("obs_id").collect()])
    assert np.allclose(np.linalg.norm(q, axis=1), [1, 2]) and abs(q[0] @ q[1]) < 1e-9
    for make in (jobs.tsne(a, max_iter=30, k_projection=1), jobs.umap(a, k=5, epochs=30)):
        base_layout = {r.obs_id: r.x for r in make.fetch().collect()}
        twins = jobs.source(pts.filter("obs_id < 3").withColumn("obs_id", F.col("obs_id") + 500))
        for r in jobs.project(make, {a: twins}).fetch().collect():
            near = np.linalg.norm(np.array(r.x) - base_layout[r.obs_id - 500])
            assert near < np.ptp(np.array(list(base_layout.values())), axis=0).max() / 2


def write_mtx(folder, m, ids, kinds, barcodes, field="integer"):
    folder.mkdir()
    cells = [(i + 1, j + 1, v) for (i, j), v in np.ndenumerate(m) if v]
    (folder / "matrix.mtx").write_text(f"%%MatrixMarket matrix coordinate {field} general\n%\n{m.shape[0]} {m.shape[1]} {len(cells)}\n" + "".join(f"{i} {j} {v}\n" for i, j, v in cells))
    (folder / "features.tsv").write_text("".join(f"{i}\t{i}\t{k}\n" for i, k in zip(ids, kinds, strict=True)))
    (folder / "barcodes.tsv").write_text("".join(f"{b}\n" for b in barcodes))
    return str(folder / "matrix.mtx")


def test_files_and_variable_keys(spark, tmp_path):
    gene, anti = "Gene Expression", "Antibody"
    one = write_mtx(tmp_path / "one", np.array([[5, 0], [7, 1], [0, 2]]), ["g0", "g0", "g1"], [gene, anti, gene], ["x", "y"])
    two = write_mtx(tmp_path / "two", np.array([[3], [4]]), ["g0", "g2"], [gene, gene], ["x"])
    genes = counts.obs_counts_sum(readers.load_files(spark, [one, two], sample_names=["one", "two"]), "n")
    assert {r.id: r.n for r in genes.var.collect()} == {"g0": 8, "g1": 2, "g2": 4}
    both = counts.obs_counts_sum(readers.load_files(spark, [one, two], sample_names=["one", "two"], prefilter=None), "n")
    assert {(r.id, r.feature_type): r.n for r in both.var.collect()} == {("g0", gene): 8, ("g0", anti): 8, ("g1", gene): 2, ("g2", gene): 4}
    assert sorted(r.cell_id for r in both.obs.collect()) == ["one_x", "one_y", "two_x"]
    real = write_mtx(tmp_path / "real", np.array([[0.5, 2], [1, 3]]), ["g0", "g1"], [gene, gene], ["x", "y"], "real")
    assert sorted(r.value for r in readers.load_mtx(spark, real, str(tmp_path / "real/features.tsv"), str(tmp_path / "real/barcodes.tsv"), sample="r").mat.collect()) == [0.5, 1, 2, 3]
    # a cell that reads like the size line
    write_mtx(tmp_path / "odd", np.array([[0, 0], [0, 1]]), ["g0", "g1"], [gene, gene], ["x", "y"])
    (tmp_path / "odd/matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n2 2 1\n2 2 1\n")
    assert readers.load_files(spark, str(tmp_path / "odd/matrix.mtx"), sample_names="o").mat.count() == 1
    with pytest.raises(FileNotFoundError):
        readers.companions(spark, str(tmp_path / "matrix.mtx"))
    with pytest.raises(ValueError):
        readers.load_files(spark, [one, two], sample_names=["one"])


def test_csv_rows_are_numbered_in_file_order(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,x\n" + "".join(f"r{i},{i * 7 % 300}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        t = readers.load_csv(spark, str(tmp_path / "t.csv"), schema="id string, x long")
        assert t.rdd.getNumPartitions() > 4
        assert [r.id for r in t.orderBy("ord").collect()] == [f"r{i}" for i in range(3000)]
        assert t.agg(F.max("ord")).first()[0] == 2999 and tables.at_positions(t, [2500, 3]).count() == 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


FAKE_H5 = '''
import pickle
import numpy as np

class Dataset(np.ndarray):
    def asstr(self):
        return self

class Group(dict):
    attrs = {}
    def __getitem__(self, path):
        out = self
        for part in path.split("/"):
            out = dict.__getitem__(out, part)
        return out

def wrap(x):
    if isinstance(x, dict):
        g = Group({k: wrap(v) for k, v in x.items() if k != "@"})
        g.attrs = x.get("@", {})
        return g
    return np.asarray(x).view(Dataset)

class File(Group):
    def __init__(self, path, mode):
        with open(path, "rb") as f:
            g = wrap(pickle.load(f))
        super().__init__(g)
        self.attrs = g.attrs
    def __enter__(self):
        return self
    def __exit__(self, *_):
        pass
'''


def test_hdf5_readers_on_a_stand_in(spark, tmp_path, monkeypatch):
    import pickle

    (tmp_path / "h5py.py").write_text(FAKE_H5)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "h5py.py"))
    rng = np.random.default_rng(9)
    m = rng.integers(0, 3, (4, 7))
    cols = [np.flatnonzero(m[:, j]) for j in range(7)]
    sparse = {"data": np.concatenate([m[c, j] for j, c in enumerate(cols)]), "indices": np.concatenate(cols), "indptr": np.cumsum([0, *map(len, cols)])}
    text = lambda xs: np.array([x.encode() for x in xs])
    feature = {"id": text(["g0", "g1", "g2", "g3"]), "name": text("abcd"), "feature_type": text(["Gene Expression"] * 4), "genome": text(["G"] * 4)}
    with open(tmp_path / "s.h5", "wb") as f:
        pickle.dump({"matrix": {**sparse, "barcodes": text([f"b{j}" for j in range(7)]), "features": feature}}, f)
    got = readers.load_files(spark, str(tmp_path / "s.h5"), sample_names="s")
    assert np.array_equal(as_array(got.mat, [f"g{i}" for i in range(4)], [f"s_b{j}" for j in range(7)]), m)
    mixed = readers.load_files(spark, [str(tmp_path / "s.h5"), write_mtx(tmp_path / "two", m[:2], ["g0", "g9"], ["Gene Expression"] * 2, [f"b{j}" for j in range(7)])], sample_names=["s", "t"])
    assert mixed.obs.count() == 14 and {r.id: r.genome for r in mixed.var.collect()}["g0"] == "ambiguous"
    obs = {"@": {"_index": "index", "column-order": ["kind", "depth"]}, "index": np.array([f"c{j}" for j in range(7)], object), "kind": {"codes": np.array([0, 1, -1, 0, 1, 1, 0]), "categories": np.array(["p", "q"], object)}, "depth": np.arange(7) / 2}
    var = {"@": {"_index": "index", "column-order": ["gene"]}, "index": np.array([f"g{i}" for i in range(4)], object), "gene": np.array(list("wxyz"), object)}
    x = {**sparse, "@": {"encoding-type": "csr_matrix", "shape": (7, 4)}}
    csc = [np.flatnonzero(m[i]) for i in range(4)]
    flipped = {"data": np.concatenate([m[i, c] for i, c in enumerate(csc)]), "indices": np.concatenate(csc), "indptr": np.cumsum([0, *map(len, csc)]), "@": {"encoding-type": "csc_matrix", "shape": (7, 4)}}
    umap = rng.normal(size=(7, 2))
    with open(tmp_path / "a.h5ad", "wb") as f:
        pickle.dump({"X": x, "layers": {"flipped": flipped, "dense": m.T.astype(float)}, "obsm": {"umap": umap}, "varm": {"pc": umap[:4]}, "obs": obs, "var": var}, f)
    ids, cells = [f"g{i}" for i in range(4)], [f"c{j}" for j in range(7)]
    for options in ({}, {"layer": "flipped"}, {"layer": "dense"}):
        a = readers.load_h5ad(spark, str(tmp_path / "a.h5ad"), **options)
        assert np.array_equal(as_array(a.mat, ids, cells), m)
    assert [(r.kind, r.depth) for r in a.obs.orderBy("ord").collect()][:3] == [("p", 0.0), ("q", 0.5), (None, 1.0)]
    assert np.allclose(as_array(readers.load_h5ad(spark, str(tmp_path / "a.h5ad"), obsm="umap").mat, ["Dim1", "Dim2"], cells), umap.T)
    assert np.allclose(as_array(readers.load_h5ad(spark, str(tmp_path / "a.h5ad"), varm="pc").mat, ids, ["Dim1", "Dim2"]), umap[:4])
    with pytest.raises(ValueError):
        readers.load_h5ad(spark, str(tmp_path / "a.h5ad"), layer="dense", obsm="umap")


def test_samples(spark, tmp_path):
    m = dense()[:4, :5]
    for name in ("one", "two"):
        with gzip.open(tmp_path / f"{name}.mtx.gz", "wt") as f:
            cells = [(i + 1, j + 1, v) for (i, j), v in np.ndenumerate(m) if v]
            f.write("%%MatrixMarket matrix coordinate integer general\n%\n" + f"4 5 {len(cells)}\n" + "".join(f"{i} {j} {v}\n" for i, j, v in cells))
        (tmp_path / f"{name}.tsv").write_text("".join(f"g{i}\tname{i}\t{'kind' if i else name}\n" for i in range(4)))
        (tmp_path / "barcodes.tsv").write_text("".join(f"bc{j}\n" for j in range(5)))
    one, two = (readers.load_mtx(spark, str(tmp_path / f"{n}.mtx.gz"), str(tmp_path / f"{n}.tsv"), str(tmp_path / "barcodes.tsv"), sample=n) for n in ("one", "two"))
    assert np.array_equal(as_array(one.mat, [f"g{i}" for i in range(4)], [f"one_bc{j}" for j in range(5)]), m)
    both = readers.load_counts({"one": one, "two": two}, keys=("id",))
    assert both.obs.count() == 10 and {r.id: r.feature_type for r in both.var.collect()}["g0"] == "ambiguous"
    assert both.mat.count() == 2 * one.mat.count()
    (tmp_path / "short.tsv").write_text("bc0\n")
    with pytest.raises(ValueError):
        readers.load_mtx(spark, str(tmp_path / "one.mtx.gz"), str(tmp_path / "one.tsv"), str(tmp_path / "short.tsv"), sample="x")
    (tmp_path / "t.csv").write_text("id,x\na,1\nb,2\n")
    assert tables.column_data(readers.load_csv(spark, str(tmp_path / "t.csv")), "x") == [1, 2]
    assert readers.file_fingerprint(spark, str(tmp_path / "t.csv")) != readers.file_fingerprint(spark, str(tmp_path / "one.tsv"))
    readers.save(one, str(tmp_path / "saved"))
    assert readers.load(spark, str(tmp_path / "saved"), obs_key="cell_id").same_as(one)


def test_streaming_sums(spark, tmp_path):
    d = matrix(spark)
    d.mat.repartition(3).write.parquet(str(tmp_path / "cells"))
    stream = spark.readStream.schema(d.mat.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "cells"))
    q = running_sums(stream).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    got = {r.obs_id: r.total for r in spark.table("sums").collect()}
    assert got == {r.id: r.s for r in counts.var_counts_sum(d, "s").obs.collect() if r.s}
