"""Loading: delimited tables, Matrix Market samples, and, where their library exists, HDF5 files."""

from __future__ import annotations

import hashlib
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmat.datamatrix import DataMatrix
from quillmat.operators import filters
from quillmat.operators.filters import Where
from quillmat.order import numbered, positioned


def load_csv(spark: SparkSession, path: str, *, sep: str = ",", header: bool = True, schema: str | None = None, **options) -> DataFrame:
    """A delimited file, or a folder of them in the order of their names, as a table with ``ord`` 0, 1, ... as they are read; give a schema to spare the pass that infers one."""
    reader = spark.read.options(sep=sep, header=header, **options)
    t = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return positioned(t)


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(n, line): a feature or barcode list with 1-based line numbers; compressed or not."""
    return positioned(spark.read.text(path), to="_n").select((F.col("_n") + 1).alias("n"), F.col("value").alias("line"))


def _named(var: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, str]:
    """``var`` and a column that identifies its rows: the first of ``keys``, or where that repeats a new column ``key`` of all of them."""
    if len(keys) == 1 or not var.groupBy(keys[0]).count().filter("count > 1").head(1):
        return var, keys[0]
    # a bar or backslash inside a part is escaped, so unlike parts never make one key
    part = lambda k: F.regexp_replace(F.coalesce(F.col(k).cast("string"), F.lit("")), r"([|\\])", r"\\$1")
    return var.withColumn("key", F.concat_ws("|", *map(part, keys))), "key"


def load_mtx(spark: SparkSession, matrix: str, features: str, barcodes: str, *, sample: str) -> DataMatrix:
    """One sample: ``matrix.mtx[.gz]``, a file or a folder of its parts in the order of their names, with features (id, name, feature_type[, genome]) as rows and barcodes as columns.

    Entries are read in parallel.  Values are long or, in a file of reals, double; a pattern's are 1.  The variable key
    is ``id``, or ``key`` of id and feature type where ids repeat.
    """
    text = spark.read.text(matrix)
    lines = text.select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")).withColumn("_at", F.monotonically_increasing_id())
    # Spark reads large files first, so the head is looked for where the first file by name begins
    top = lines.filter(F.col("_path").endswith(urlsplit(min(text.inputFiles())).path) & (F.col("_start") == 0))
    banner = top.first()["value"].lower().split()
    field = banner[3] if len(banner) > 3 and banner[0].startswith("%%") else "integer"
    is_row = ~F.col("value").startswith("%") & (F.trim("value") != "")
    rows, size_line = lines.filter(is_row), top.filter(is_row).first()
    size = [int(x) for x in size_line["value"].split()]
    names = ["id", "name", "feature_type", "genome"]
    fields = F.split("line", "\t")
    listed = _listed(spark, features)
    width = min(len(names), listed.select(F.size(fields)).first()[0])
    var = listed.select(F.col("n"), *[fields[k].alias(names[k]) for k in range(width)]).withColumn("ord", F.col("n") - 1)
    var, key = _named(var, ("id", "feature_type") if width > 2 else ("id",))
    obs = _listed(spark, barcodes).select("n", F.concat_ws("_", F.lit(sample), "line").alias("cell_id"), F.lit(sample).alias("sample_name"), F.col("line").alias("barcode"), (F.col("n") - 1).alias("ord"))
    p, n = var.count(), obs.count()
    if (size[0], size[1]) != (p, n):
        raise ValueError(f"the matrix is {size[0]} x {size[1]}, the lists have {p} and {n} lines")
    part = F.split(F.trim("value"), r"\s+")
    value = F.lit(1) if field == "pattern" else part[2]
    cells = rows.filter(F.col("_at") != size_line["_at"]).select(part[0].cast("long").alias("i"), part[1].cast("long").alias("j"), value.cast("double" if field == "real" else "long").alias("value"))
    mat = cells.join(var.select(F.col("n").alias("i"), F.col(key).alias("var_id")), "i").join(obs.select(F.col("n").alias("j"), F.col("cell_id").alias("obs_id")), "j").select("var_id", "obs_id", "value")
    return DataMatrix(mat.filter("value <> 0"), var.drop("n"), obs.drop("n"), key, "cell_id")


def load_counts(samples: dict[str, DataMatrix], *, keys: tuple[str, ...] = ("id", "feature_type"), prefilter: Where = None) -> DataMatrix:
    """Samples side by side: variables are matched by their identifying columns, a sample without one has zeros there.

    ``prefilter`` selects variables of each sample first.  Other columns in which samples disagree say ``ambiguous``; missing ones
    are empty.  Observations become ``sample_barcode``.  The variable key is the first of ``keys``, or, where that repeats, a
    column ``key`` made of all of them; cells go by the whole match.
    """
    samples = {n: d if prefilter is None else filters.filter_var(prefilter, d) for n, d in samples.items()}
    var, obs = None, None
    for k, (name, d) in enumerate(samples.items()):
        own = d.var.withColumns({"_s": F.lit(k), "_local": F.col(d.var_key)})
        var = own if var is None else var.unionByName(own, allowMissingColumns=True)
        rows = d.obs if d.obs_key == "cell_id" else d.obs.select(F.concat_ws("_", F.lit(name), F.col(d.obs_key).cast("string")).alias("cell_id"), F.lit(name).alias("sample_name"), F.col(d.obs_key).cast("string").alias("barcode"), "ord")
        rows = rows.select("cell_id", "sample_name", "barcode", "ord").withColumn("_s", F.lit(k))
        obs = rows if obs is None else obs.union(rows)
    keys = tuple(k for k in keys if k in var.columns)
    rest = [c for c in var.columns if c not in (*keys, "ord", "_s", "_local", "key")]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = lambda c: F.when(F.count_distinct(text(c)) == 1, F.first(text(c))).otherwise("ambiguous").alias(c)
    merged = var.groupBy(*keys).agg(*[one(c) for c in rest], F.min(F.struct("_s", "ord")).alias("_first"))
    merged, key = _named(numbered(merged, "_first", *keys).drop("_first"), keys)
    place = None
    if key != keys[0] or any(d.var_key != key for d in samples.values()):
        joint = merged.select(F.col(key).alias("_key"), *[F.col(k).alias(f"_{k}") for k in keys])
        on = [var[k].eqNullSafe(joint[f"_{k}"]) for k in keys]
        place = var.join(joint, on).select("_s", F.col("_local").alias("var_id"), "_key")
    mat = None
    for k, (name, d) in enumerate(samples.items()):
        cell = F.col("obs_id").cast("string") if d.obs_key == "cell_id" else F.concat_ws("_", F.lit(name), F.col("obs_id").cast("string"))
        cells = d.mat.withColumn("obs_id", cell)
        if place is not None:
            cells = cells.join(place.filter(F.col("_s") == k), "var_id").select(F.col("_key").alias("var_id"), "obs_id", "value")
        mat = cells if mat is None else mat.union(cells)
    return DataMatrix(mat, merged, numbered(obs.withColumnRenamed("ord", "_o"), "_s", "_o", "cell_id").drop("_s", "_o"), key, "cell_id")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def companions(spark: SparkSession, matrix: str) -> tuple[str, str]:
    """The feature and barcode lists that belong to ``...matrix.mtx[.gz]``: in its folder, with the same beginning of the name."""
    folder, _, file = matrix.rpartition("/")
    stem = file.removesuffix(".gz").removesuffix(".mtx").removesuffix("matrix")
    found = []
    for kinds in (("features", "genes"), ("barcodes",)):
        options = [f"{folder}/{stem}{kind}.tsv{end}".lstrip("/") if not folder else f"{folder}/{stem}{kind}.tsv{end}" for kind in kinds for end in (".gz", "")]
        own = next((o for o in options if _exists(spark, o)), None)
        if own is None:
            raise FileNotFoundError(f"no list of {kinds[0]} beside {matrix}")
        found.append(own)
    return found[0], found[1]


def _several(x) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x]


def load_files(spark: SparkSession, files, *, sample_names, feature_files=None, barcode_files=None, prefilter: Where = "feature_type = 'Gene Expression'", extra_id_cols=("feature_type",)) -> DataMatrix:
    """Samples from files (one or several, HDF5 and Matrix Market mixed at will) side by side, see :func:`load_counts`.

    The lists beside a Matrix Market file are found by its name unless given.  By default only gene expression is kept, and variables
    are matched by identifier and ``extra_id_cols``.
    """
    files, names = _several(files), _several(sample_names)
    if len(files) != len(names):
        raise ValueError(f"{len(files)} files, but {len(names)} sample names")
    lists = []
    for given, what in ((feature_files, "feature"), (barcode_files, "barcode")):
        given = [None] * len(files) if given is None else _several(given)
        if len(given) != len(files):
            raise ValueError(f"{len(files)} matrix files, but {len(given)} {what} files")
        lists.append(given)
    samples = {}
    for file, name, features, barcodes in zip(files, names, *lists, strict=True):
        if file.lower().endswith(".h5"):
            samples[name] = load_h5(spark, file, sample=name)
        else:
            guessed = (features, barcodes) if features and barcodes else companions(spark, file)
            samples[name] = load_mtx(spark, file, features or guessed[0], barcodes or guessed[1], sample=name)
    extra = tuple(_several(extra_id_cols)) if extra_id_cols else ()
    return load_counts(samples, keys=("id", *extra), prefilter=prefilter)


def load_h5(spark: SparkSession, path: str, *, sample: str) -> DataMatrix:
    """One sample from a sparse HDF5 file of counts, read by ranges of barcodes; needs the optional library h5py."""
    from quillmat.sources import hdf5

    listed = {c: (f"matrix/features/{c}", "string") for c in ("id", "name", "feature_type", "genome")}
    var = hdf5.read_columns(spark, path, listed).withColumn("ord", F.col("n"))
    var, key = _named(var, ("id", "feature_type"))
    barcodes = hdf5.read_columns(spark, path, {"barcode": ("matrix/barcodes", "string")})
    obs = barcodes.select("n", F.concat_ws("_", F.lit(sample), "barcode").alias("cell_id"), F.lit(sample).alias("sample_name"), "barcode", F.col("n").alias("ord"))
    cells = hdf5.read_cells(spark, path, "matrix").join(var.select(F.col("n").alias("inner"), F.col(key).alias("var_id")), "inner").join(obs.select(F.col("n").alias("outer"), F.col("cell_id").alias("obs_id")), "outer")
    return DataMatrix(cells.select("var_id", "obs_id", F.col("value").cast("long").alias("value")), var.drop("n"), obs.drop("n"), key, "cell_id")


def load_h5ad(spark: SparkSession, path: str, *, layer: str | None = None, obsm: str | None = None, obsp: str | None = None, varm: str | None = None, varp: str | None = None) -> DataMatrix:
    """A matrix of an annotated-data file, its main one or one alternative, as variables x observations, read by ranges; needs h5py."""
    import h5py

    from quillmat.sources import hdf5

    chosen = {k: v for k, v in {"layers": layer, "obsm": obsm, "obsp": obsp, "varm": varm, "varp": varp}.items() if v is not None}
    if len(chosen) > 1:
        raise ValueError("choose one of layer, obsm, obsp, varm, varp")
    kind, name = next(iter(chosen.items()), ("X", None))
    group = "X" if kind == "X" else f"{kind}/{name}"
    types = {"b": "boolean", "i": "long", "u": "long", "f": "double"}

    with h5py.File(path, "r") as f:
        g = f[group]
        sparse = isinstance(g, h5py.Group)
        by_column = sparse and g.attrs["encoding-type"] == "csc_matrix"
        width = int(g.attrs["shape"][1] if sparse else g.shape[1])
        described = {}
        for t in ("obs", "var"):
            columns = {"id": (f"{t}/{f[t].attrs['_index']}", "string")}
            for c in f[t].attrs["column-order"]:
                own = f[t][c]
                columns[c] = (f"{t}/{c}", "string" if isinstance(own, h5py.Group) else types.get(own.dtype.kind, "string"))
            described[t] = columns
    obs, var = (hdf5.read_columns(spark, path, described[t]).withColumn("ord", F.col("n")) for t in ("obs", "var"))
    dims = spark.range(width).select(F.col("id").alias("n"), F.concat(F.lit("Dim"), (F.col("id") + 1).cast("string")).alias("id"), F.col("id").alias("ord"))
    rows, cols = {"X": (obs, var), "layers": (obs, var), "obsm": (obs, dims), "varm": (var, dims), "obsp": (obs, obs), "varp": (var, var)}[kind]
    cells = hdf5.read_cells(spark, path, group, dense=not sparse)
    cells = cells.select(F.col("inner" if by_column else "outer").alias("r"), F.col("outer" if by_column else "inner").alias("c"), "value").filter("value <> 0")
    cells = cells.join(rows.select(F.col("n").alias("r"), F.col("id").alias("row_id")), "r").join(cols.select(F.col("n").alias("c"), F.col("id").alias("col_id")), "c")
    if kind in ("varm", "varp"):  # variables are the rows already
        return DataMatrix(cells.select(F.col("row_id").alias("var_id"), F.col("col_id").alias("obs_id"), "value"), rows.drop("n"), cols.drop("n"))
    return DataMatrix(cells.select(F.col("col_id").alias("var_id"), F.col("row_id").alias("obs_id"), "value"), cols.drop("n"), rows.drop("n"))


def file_fingerprint(spark: SparkSession, path: str) -> str:
    """Path, size and time of a file in any file system that Spark reads, for telling jobs' sources apart."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    status = p.getFileSystem(conf).getFileStatus(p)
    return hashlib.sha256(f"{path}|{status.getLen()}|{status.getModificationTime()}".encode()).hexdigest()


def save(data: DataMatrix, path: str) -> None:
    """Each field as Parquet below ``path``; symbolic terms must be materialized before."""
    if data.terms:
        raise ValueError("materialize the matrix first")
    for name in ("mat", "var", "obs"):
        getattr(data, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, *, var_key: str = "id", obs_key: str = "id") -> DataMatrix:
    return DataMatrix(*[spark.read.parquet(f"{path}/{n}") for n in ("mat", "var", "obs")], var_key, obs_key)
