"""Jobs: a pipeline as a graph of steps, each with what it fitted and how it is applied.

``project(job, {old: new})`` runs a pipeline again on new input, while whatever was fitted on the base
data stays as it was: like an estimator and its model, for every step at once.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmat.datamatrix import DataMatrix
from quillmat.operators import counts, design, filters, layouts, neighbors, reduce, stats, tables, transforms
from quillmat.plans.store import default_store
from quillmat.sources import readers


class Fields:
    """A job seen field by field: asking for ``mat``, ``var``, ``obs`` or a key works out no more than that."""

    def __init__(self, job: Job):
        self.job = job

    def __getattr__(self, name: str) -> Any:
        return self.job.field(name)


class Job:
    """A step: inputs, parameters, ``fit(*inputs, **params) -> state`` and ``apply(state, *inputs, **params) -> result``.

    States and results are made once per job; states are written to the store of ``plans.store`` and read from there, so a
    fit stays what it was, whatever reads it.  Equal steps on equal inputs have equal fingerprints.
    """

    def __init__(self, name: str, inputs: tuple = (), params: dict | None = None, *, step: Step | None = None, origin: Job | None = None, content: str = "", lasting: bool = True):
        self.name, self.inputs, self.params = name, tuple(inputs), params or {}
        self.step, self.origin, self._content, self._lasting = step or Step(), origin, content, lasting
        self._state: Any = None
        self._result: Any = None
        self._fields: dict[str, Any] = {}

    def state(self) -> Any:
        """What was fitted: on the base's inputs, if this is a projected job."""
        if self.origin is not None:
            return self.origin.state()
        if self._state is None and self.step.fit is not None:
            address, lasting = self.address(of_state=True)
            make = lambda: self.step.fit(*[Fields(i) if self.step.light else i.fetch() for i in self.inputs], **self.params)
            spark = SparkSession.getActiveSession()
            self._state = default_store(spark, lasting).keep(address, make, f"{self.name} state") if spark and self.step.keep else make()
        return self._state

    def fetch(self) -> Any:
        if self._result is None:
            made = self.step.base if self.origin is None and self.step.base is not None else self.step.apply
            given = self.state if made is self.step.base else self.state()
            self._result = made(given, *[i.fetch() for i in self.inputs], **self.params)
        return self._result

    def field(self, name: str) -> Any:
        """One field of a matrix: by the step's own rule for it, from the first input if the step leaves it alone, else from the whole result."""
        if self._result is None and name not in self._fields:
            if (rule := self.step.fields.get(name)) is not None:
                self._fields[name] = rule(self.state, *map(Fields, self.inputs), **self.params)
            elif name in self.step.leaves:
                self._fields[name] = self.inputs[0].field(name)
        return self._fields[name] if name in self._fields else getattr(self.fetch(), name)

    def fingerprint(self) -> str:
        """What tells jobs of this session apart."""
        own = "|".join([self.name, _content(self.params), self._content, *[i.fingerprint() for i in self.inputs], self.origin.fingerprint() if self.origin else ""])
        return hashlib.sha256(own.encode()).hexdigest()

    def address(self, of_state: bool = False) -> tuple[str, bool]:
        """A digest of everything that the job (or its state) follows from, and whether it means the same to other sessions."""
        lasting = [self._lasting]
        parts = [VERSION, (self.step.fitted_as or self.name) if of_state else self.name, _lasting_content(self.params, lasting), self._content]
        for i in [*self.inputs, *([self.origin] if self.origin else [])]:
            own, known = i.address()
            parts.append(own)
            lasting.append(known)
        return hashlib.sha256("|".join(parts).encode()).hexdigest() + ("-state" if of_state else ""), all(lasting)

    def __repr__(self) -> str:
        return f"{self.name}({', '.join(map(repr, self.inputs))})"


@dataclass(frozen=True)
class Step:
    """How a kind of job works.

    ``base`` replaces ``apply`` on the data it was fitted on, and gets a function that gives the state.  ``frozen`` names the arguments (inputs by
    number, parameters by name) that projection leaves as they are; it follows all others.  ``leaves`` are fields that pass through
    unchanged, ``fields`` rules that make a field without the others.  A ``light`` fit gets its inputs field by field.  States of steps with the same
    ``fitted_as``, inputs and parameters are one; ``keep`` False keeps a state out of the store.
    """

    fit: Callable | None = None
    apply: Callable | None = None
    base: Callable | None = None
    frozen: tuple = ()
    leaves: tuple = ()
    fields: dict[str, Callable] = field(default_factory=dict)
    light: bool = False
    fitted_as: str = ""
    keep: bool = True


#: Part of every address; a change of what fits mean must change it.
VERSION = "2"


class Choice(Job):
    """The second input if the first one's result is true, else the third; only the chosen one is worked out."""

    def fetch(self) -> Any:
        condition, yes, no = self.inputs
        return (yes if condition.fetch() else no).fetch()


def ifelse(condition: Job, yes: Job, no: Job) -> Job:
    return Choice("ifelse", (condition, yes, no))


def _content(value: Any) -> str:
    """What tells parameters apart: plans of tables by their meaning, anything else by its text."""
    if isinstance(value, DataFrame):
        return f"table {value.semanticHash()}"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{_content(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, (list, tuple)):
        return "(" + ",".join(map(_content, value)) + ")"
    return f"{type(value).__name__} {value!r}" if not callable(value) else f"function {id(value)}"


def _lasting_content(value: Any, lasting: list[bool]) -> str:
    """As ``_content``, but of functions what they do; appends False for what another session can't recognize."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{_lasting_content(v, lasting)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, (list, tuple)):
        return "(" + ",".join(_lasting_content(v, lasting) for v in value) + ")"
    code = getattr(value, "__code__", None)
    if code is not None and not value.__closure__ and not value.__defaults__ and not any(hasattr(c, "co_code") for c in code.co_consts):
        return f"function {value.__module__} {code.co_code.hex()} {code.co_consts!r} {code.co_names!r}"
    if callable(value) or isinstance(value, DataFrame):
        lasting.append(False)
    elif not isinstance(value, bool | int | float | str | range | type(None)):
        lasting.append(" at 0x" not in repr(value) and not isinstance(value, Column))
    return _content(value)


def source(value: DataMatrix | DataFrame, name: str = "source", content: str = "") -> Job:
    """A leaf; ``content`` (a path with size and time, say) tells leaves apart in all sessions, by default the object itself does, in this one.

    What is fitted on a leaf without content is stored for this session only.
    """
    own = content or f"object {next(_numbers)}"
    return Job(name, (), {}, step=Step(apply=lambda _: value), content=own, lasting=bool(content))


_numbers = itertools.count()


def fields_source(content: str, **fields: Callable[[], Any]) -> Job:
    """A leaf whose fields (mat, var, obs, and keys other than ``id``) are made when they are asked for, each by its own function."""
    held = {"var_key": lambda: "id", "obs_key": lambda: "id", "terms": lambda: (), **fields}
    rules = {n: (lambda _, f=f: f()) for n, f in held.items()}
    whole = lambda _: DataMatrix(*[held[n]() for n in ("mat", "var", "obs", "var_key", "obs_key", "terms")])
    return Job("fields", (), {}, step=Step(apply=whole, fields=rules), content=content)


def file_source(spark: SparkSession, path: str, read: Callable[[SparkSession, str], Any]) -> Job:
    """A leaf read from a file; the file's path, size and time tell it apart, and ``project`` replaces it by its path."""
    lasting: list[bool] = []
    reader = _lasting_content(read, lasting)
    return Job("file", (), {"path": path}, step=Step(apply=lambda _, path: read(spark, path)), content=f"{reader}|{readers.file_fingerprint(spark, path)}", lasting=all(lasting))


def matrix_source(spark: SparkSession, path: str, *, var_key: str = "id", obs_key: str = "id") -> Job:
    """A leaf read from a folder that ``readers.save`` wrote, field by field."""
    rules = {n: (lambda _, path, n=n: spark.read.parquet(f"{path}/{n}")) for n in ("mat", "var", "obs")}
    rules |= {"var_key": lambda _, path: var_key, "obs_key": lambda _, path: obs_key, "terms": lambda _, path: ()}
    return Job("matrix", (), {"path": path}, step=Step(apply=lambda _, path: readers.load(spark, path, var_key=var_key, obs_key=obs_key), fields=rules), content=f"{var_key}|{obs_key}|{readers.file_fingerprint(spark, path)}")


def project(job: Job, new: dict[Any, Any]) -> Job:
    """The pipeline with some of its jobs replaced; every step above a replaced one keeps its fitted state and its frozen arguments.

    A job is replaced by the value of an equal one (of the same fingerprint) among the keys.  Other keys, such as paths, replace
    equal parameters of jobs.
    """
    jobs = {old.fingerprint(): to for old, to in new.items() if isinstance(old, Job)}
    constants = [(old, to) for old, to in new.items() if not isinstance(old, Job)]
    done: dict[int, Job] = {}

    def changed(v: Any) -> Any:
        return next((to for old, to in constants if type(old) is type(v) and old == v), v) if not isinstance(v, DataFrame) else v

    def walk(j: Job) -> Job:
        if id(j) not in done:
            if (found := jobs.get(j.fingerprint())) is not None:
                done[id(j)] = found
                return found
            inputs = [i if k in j.step.frozen else walk(i) for k, i in enumerate(j.inputs)]
            params = {k: v if k in j.step.frozen else changed(v) for k, v in j.params.items()}
            if all(a is b for a, b in zip(inputs, j.inputs, strict=True)) and all(params[k] is v for k, v in j.params.items()):
                done[id(j)] = j
            else:
                content = "" if not j.inputs and params != j.params else j._content
                done[id(j)] = type(j)(j.name, tuple(inputs), params, step=j.step, origin=(j.origin or j) if j.step.fit else None, content=content, lasting=j._lasting)
        return done[id(j)]

    return walk(job)


def step(name: str, apply: Callable, fit: Callable | None = None, **how) -> Callable[..., Job]:
    """A constructor of jobs: positional arguments are input jobs, keywords parameters; ``how``: see :class:`Step`."""

    def make(*inputs: Job, **params) -> Job:
        return Job(name, inputs, params, step=made)

    made = Step(fit=fit, apply=apply, **how)
    make.__name__ = name
    return make


def apply_job(f: Callable, *inputs: Job, frozen: tuple = (), **params) -> Job:
    """A step of one's own: ``f(*results, **params)``; projection leaves the inputs numbered, and the parameters named, in ``frozen`` as they are."""
    return Job(f"apply {getattr(f, '__qualname__', f)}", inputs, params, step=Step(apply=lambda _, *a, **k: f(*a, **k), frozen=tuple(frozen)), content=_content(f))


def _ids(table: DataFrame) -> DataFrame:
    return tables.id_column(table)


def _filter_var(state, data, where, project_ids="intersect"):
    if project_ids == "no":
        return filters.filter_var(where, data)
    return filters.subset_var(data, state, missing="error" if project_ids == "yes" else "skip")


def _filter_obs(state, data, where, project_ids="no"):
    if project_ids == "no":
        return filters.filter_obs(where, data)
    return filters.subset_obs(data, state, missing="error" if project_ids == "yes" else "skip")


def _selected(data, name, where=None, f=None, part=None, total=None):
    return {k: _ids(filters.select_rows(data.var, w)) for k, w in (("where", where), ("part", part), ("total", total)) if w is not None}


def _semi(ids):
    """A predicate on var: to be among frozen identifiers."""
    return (ids.select(tables.id_name(ids), F.lit(True).alias("_in"), "ord"), lambda c: c.isNotNull())


def _rows(side: str, get_state, data, where, project_ids):
    """The filtered table alone; on the base it is what the predicate admits, as in the projection by these identifiers."""
    table = getattr(data, side)
    if project_ids == "no":
        return filters.select_rows(table, where)
    return tables.lookup(get_state(), table, missing="error" if project_ids == "yes" else "skip")


# Frozen on the base: identifiers of selected variables.  Observations are always selected anew.
filter_var = step(
    "filter_var", _filter_var, lambda data, where, project_ids="intersect": _ids(filters.select_rows(data.var, where)) if project_ids != "no" else None,
    light=True, leaves=("obs", "var_key", "obs_key"), fields={"var": lambda s, data, where, project_ids="intersect": _rows("var", s, data, where, project_ids)},
)
filter_obs = step(
    "filter_obs", _filter_obs, lambda data, where, project_ids="no": _ids(filters.select_rows(data.obs, where)) if project_ids != "no" else None,
    light=True, leaves=("var", "var_key", "obs_key"), fields={"obs": lambda s, data, where, project_ids="no": _rows("obs", s, data, where, project_ids)},
)
subset_var = step("subset_var", lambda _, data, ids: filters.subset_var(data, ids), leaves=("obs", "var_key", "obs_key"), fields={"var": lambda _, data, ids: tables.lookup(ids, data.var)})
subset_obs = step("subset_obs", lambda _, data, ids: filters.subset_obs(data, ids), leaves=("var", "var_key", "obs_key"), fields={"obs": lambda _, data, ids: tables.lookup(ids, data.obs)})


class Field(Job):
    """One field of its input, worked out without the others where the steps below allow it; projection reaches through it."""

    def fetch(self) -> Any:
        if self._result is None:
            self._result = self.inputs[0].field(self.name.removeprefix("get_"))
        return self._result


def get_matrix(data: Job) -> Job:
    return Field("get_mat", (data,))


def get_var(data: Job) -> Job:
    return Field("get_var", (data,))


def get_obs(data: Job) -> Job:
    return Field("get_obs", (data,))


def _at_positions(side: str) -> Callable[..., Job]:
    """Rows by number.  Numbers mean nothing in another table, so under projection its identifiers must be the same, in the same order."""
    ids = lambda data: tables.id_column(getattr(data, side))

    subset = filters.subset_var if side == "var" else filters.subset_obs

    def apply(base, data, positions):
        own = ids(data)
        if own.exceptAll(base).head(1) or base.exceptAll(own).head(1):
            raise ValueError("positions can't be projected to other identifiers")
        return subset(data, tables.at_positions(own, positions))

    on_base = lambda _, data, positions: subset(data, tables.at_positions(ids(data), positions))
    return step(f"{side}_at_positions", apply, lambda data, positions: ids(data), base=on_base, light=True)


_TABLES = ("var", "obs", "var_key", "obs_key")
_ALL_BUT_VAR, _ALL_BUT_OBS = ("mat", "obs", "var_key", "obs_key", "terms"), ("mat", "var", "var_key", "obs_key", "terms")


def _with_idf(get_state, data, annotate=False, **_):
    return data.var.join(get_state().withColumnRenamed("var_id", data.var_key), data.var_key) if annotate else data.var


var_at_positions, obs_at_positions = _at_positions("var"), _at_positions("obs")
var_counts_sum = step("var_counts_sum", lambda s, data, name, where=None, f=None: counts.var_counts_sum(data, name, _semi(s["where"]) if s else None, f), _selected, light=True, leaves=_ALL_BUT_OBS)
var_counts_fraction = step("var_counts_fraction", lambda s, data, name, part, total=None: counts.var_counts_fraction(data, name, _semi(s["part"]), _semi(s["total"]) if "total" in s else None), _selected, light=True, leaves=_ALL_BUT_OBS)
obs_counts_sum = step("obs_counts_sum", lambda _, data, name, where=None, f=None: counts.obs_counts_sum(data, name, where, f), leaves=_ALL_BUT_VAR)
obs_counts_fraction = step("obs_counts_fraction", lambda _, data, name, part, total=None: counts.obs_counts_fraction(data, name, part, total), leaves=_ALL_BUT_VAR)
annotate_var = step("annotate_var", lambda _, data, table: data.with_var(tables.left_join(data.var, table)), leaves=_ALL_BUT_VAR, fields={"var": lambda _, data, table: tables.left_join(data.var, table)})
annotate_obs = step("annotate_obs", lambda _, data, table: data.with_obs(tables.left_join(data.obs, table)), leaves=_ALL_BUT_OBS, fields={"obs": lambda _, data, table: tables.left_join(data.obs, table)})
log_transform = step("log_transform", lambda _, data, **k: transforms.log_transform(data, **k), leaves=_TABLES)
tf_idf_transform = step("tf_idf_transform", lambda idf, data, **k: transforms.tf_idf_transform(data, idf=idf, **k), lambda data, **_: transforms.inverse_frequencies(data), leaves=("obs", "var_key", "obs_key"), fields={"var": _with_idf})
transpose = step(
    "transpose", lambda _, data: data.transposed(),
    fields={"var": lambda _, data: data.obs, "obs": lambda _, data: data.var, "var_key": lambda _, data: data.obs_key, "obs_key": lambda _, data: data.var_key},
)


def _fit_sct(data, var_where=None, min_cells=5, **_):
    totals = transforms.observation_totals(data, var_where)
    return transforms.fitted_parameters(data, totals, min_cells).drop("outlier"), totals.count()


sctransform = step("sctransform", lambda s, data, **k: transforms.sctransform(data, params=s[0], base_n=s[1], **k), _fit_sct)


def _fit_norm(data, covariates=(), center=True, rtol=None):
    d = design.fit_design(data.obs, *covariates, center=center)
    return d, design.negative_regression(data, d, rtol=rtol)


normalize_matrix = step("normalize_matrix", lambda s, data, covariates=(), center=True, rtol=None: design.normalize(data, design=s[0], beta=s[1]), _fit_norm, fitted_as="regression", leaves=("mat", *_TABLES))
negative_regression = step("negative_regression", lambda s, data, covariates=(), center=True, rtol=None: s[1], _fit_norm, fitted_as="regression")
design_matrix = step("design_matrix", lambda s, data, covariates=(), **_: s.rows(data.obs, data.obs_key), lambda data, covariates=(), **k: design.fit_design(data.obs, *covariates, **k), light=True)


def _spread(name: str) -> Callable[..., Job]:
    """A column of var as it is on the base, or with ``project="yes"`` worked out anew."""
    f = {"variance": counts.variance, "std": counts.std, "relative_std": counts.relative_std}[name]

    def fit(data, project="no", **k):
        return tables.annotation(f(data, **k).var, k.get("name", name))

    def apply(column, data, project="no", **k):
        if project not in ("yes", "no"):
            raise ValueError(f"unknown mode {project!r}")
        return f(data, **k) if project == "yes" else data.with_var(tables.left_join(data.var, column))

    on_base = lambda state, data, project="no", **k: data.with_var(tables.left_join(data.var, state())) if project in ("yes", "no") else apply(None, data, project)
    return step(name, apply, fit, base=on_base, leaves=_ALL_BUT_VAR)


variance, std, relative_std = map(_spread, ("variance", "std", "relative_std"))


def _svd(factors, data, **_):
    scores = reduce.project_scores(factors, data)
    return reduce.Factors(factors.u, factors.s, scores.select("obs_id", reduce._combine("x", np.diag(1 / np.maximum(factors.s, 1e-100))).alias("v")))


def _base_scores(factors):
    return factors.v.select("obs_id", reduce._combine("v", np.diag(factors.s)).alias("x"))


def _fit_svd(data, **k):
    return reduce.svd(data, **k)


svd = step("svd", _svd, _fit_svd, base=lambda s, data, **_: s(), fitted_as="svd")
pca = step("pca", lambda s, data, **_: reduce.project_scores(s, data), _fit_svd, base=lambda s, data, **_: _base_scores(s()), fitted_as="svd")
loadings = step("loadings", lambda s, data, **_: s.u, _fit_svd, fitted_as="svd")


def _fit_signature(data, where, as_loadings=False, nsv=1, subspace=10, **k):
    chosen = filters.filter_var(where, data)
    fitted = design.fit_design(chosen.obs)
    beta = design.negative_regression(chosen, fitted)
    return reduce.svd(design.normalize(chosen, design=fitted, beta=beta), nsv=nsv, subspace=subspace, **k), fitted, beta, _ids(chosen.var)


def _signature(state, data, where, as_loadings=False, **_):
    factors, fitted, beta, ids = state
    if as_loadings:
        return factors.u
    same = filters.subset_var(data, ids)  # every variable of the signature must be there
    return reduce.project_scores(factors, design.normalize(same, design=fitted, beta=beta))


signature = step("signature", _signature, _fit_signature, base=lambda s, data, where, as_loadings=False, **_: s()[0].u if as_loadings else _base_scores(s()[0]))
local_outlier_factor = step(
    "local_outlier_factor",
    lambda s, coords, full, k=10, name="LOF": neighbors.local_outlier_factor(coords, full, k=k, name=name, base=s),
    lambda coords, full, k=10, name="LOF": (coords, full),
    base=lambda _, coords, full, k=10, name="LOF": neighbors.local_outlier_factor(coords, full, k=k, name=name),
)
transfer_annotation = step("transfer_annotation", lambda _, base, labels, new, **k: neighbors.transfer_annotation(base, labels, new, **k))
transform_coords = step("transform_coords", lambda m, coords, groups, dims, order=None: transforms.transform_coords(coords, m), lambda coords, groups, dims, order=None: transforms.optimal_transform(coords, groups, dims, order))
pseudobulk = step(
    "pseudobulk",
    lambda s, data, by, new_var=(), delim="_": counts.pseudobulk(data, *by, new_var=new_var, delim=delim, extras=s),
    lambda data, by, new_var=(), delim="_": counts.new_categories(data.obs, new_var, delim) if new_var else None,
)
population_matrix = step(
    "population_matrix",
    lambda s, data, by, new_var, delim="_": counts.population_matrix(data.obs, *by, new_var=new_var, delim=delim, extras=s),
    lambda data, by, new_var, delim="_": counts.new_categories(data.obs, (new_var,) if isinstance(new_var, str) else tuple(new_var), delim),
)


def _pick(k: dict, *names: str) -> dict:
    return {n: v for n, v in k.items() if n in names}


# Tests are made anew, with the designs and labels of the base.
ftest = step(
    "ftest", lambda s, data, h1, **k: stats.ftest(data, h1, designs=s, **k),
    lambda data, h1, **k: stats.ftest_designs(stats.ready(data, [*k.get("h0", ()), *h1], k.get("h1_missing", "skip")).obs, h1, **_pick(k, "h0", "center", "max_categories")),
)
ttest = step(
    "ttest", lambda s, data, h1, **k: stats.ttest(data, h1, designs=s, **k),
    lambda data, h1, **k: stats.ttest_designs(stats.ready(data, [*k.get("h0", ()), h1], k.get("h1_missing", "skip")).obs, h1, **_pick(k, "h0", "center")),
)
mannwhitney = step(
    "mannwhitney", lambda s, data, column, a=None, b=None, **k: stats.mannwhitney(data, column, groups=s, **k),
    lambda data, column, a=None, b=None, **_: stats.two_groups(data.obs, column, a, b),
)


def _layout(name: str, place: Callable[..., DataFrame]) -> Callable[..., Job]:
    """The base points' layout; under projection new points are embedded by their neighbours among them."""

    def fit(points, k_projection=10, dims=2, **options):
        return points, place(points, dims=dims, **options)

    def apply(state, points, k_projection=10, dims=2, **_):
        base, layout = state
        return neighbors.embed(neighbors.nearest(points, base, k_projection), layout, dims)

    return step(name, apply, fit, base=lambda state, *_, **__: state()[1])


def _placed(points: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> tuple[DataFrame, list, np.ndarray, np.ndarray]:
    rows = points.select("obs_id", "x").orderBy("obs_id").collect()
    x = np.array([r["x"] for r in rows], float)
    ids, y = [r["obs_id"] for r in rows], f(x)
    return points.sparkSession.createDataFrame(list(zip(ids, y.tolist(), strict=True)), f"obs_id {points.schema['obs_id'].dataType.simpleString()}, x array<double>"), ids, x, y


tsne = _layout("tsne", layouts.tsne)


def _fit_umap(points, dims=2, **k):
    layout, _, x, y = _placed(points, lambda x: neighbors.umap(x, dims=dims, **k))
    return layout, x, y


def _umap(state, points, dims=2, **k):
    _, x, y = state
    held, options = points.sparkSession.sparkContext.broadcast((x, y)), {n: v for n, v in k.items() if n != "epochs"}
    kind = points.schema["obs_id"].dataType.simpleString()

    def place(batches):
        bx, by = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                new = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                out = neighbors.umap(new, dims=dims, base=bx, place=by, epochs=k.get("epochs", 200) // 3, **options)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.tolist(), pa.list_(pa.float64()))], ["obs_id", "x"])

    return points.select("obs_id", "x").mapInArrow(place, f"obs_id {kind}, x array<double>")


umap = step("umap", _umap, _fit_umap, base=lambda state, *_, **__: state()[0])  # new points are moved by the base's model, within their tasks


def _force(points: DataFrame, dims: int, k: int = 10, **options) -> DataFrame:
    return layouts.force_layout(points, neighbors.adjacency(neighbors.knn(points, k)), dims=dims, **options)


force_layout = _layout("force_layout", _force)


def cached(job: Job) -> Job:
    """The same result, kept in Spark's storage."""

    def keep(_, value):
        if isinstance(value, DataMatrix):
            return DataMatrix(value.mat.persist(), value.var.persist(), value.obs.persist(), value.var_key, value.obs_key, value.terms)
        return value.persist() if isinstance(value, DataFrame) else value

    return Job("cached", (job,), step=Step(apply=keep))


class Stored(Job):
    """The same result, written to the store once; a session that finds it there works nothing out."""

    def fetch(self) -> Any:
        if self._result is None:
            (inner,) = self.inputs
            address, lasting = inner.address()
            self._result = default_store(SparkSession.getActiveSession(), lasting).keep(address, inner.fetch, f"{inner.name} result")
        return self._result


def stored(job: Job) -> Job:
    return Stored("stored", (job,))


def forget(job: Job) -> int:
    """Remove what the store holds of a job: its state and its result.  Jobs that read them already can't any more."""
    spark, gone = SparkSession.getActiveSession(), 0
    for of_state in (True, False):
        address, lasting = job.address(of_state)
        gone += default_store(spark, lasting).remove(address)
    return gone
