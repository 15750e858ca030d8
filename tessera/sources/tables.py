"""Reading keyed numeric tables, catalogues of files, and label dictionaries."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ordering import number_rows, top_k

LABEL_SCHEMA = "map<string, struct<label:string, include:boolean, confidence:int, notes:string>>"

# Image file endings.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL in floating columns, so aggregates skip missing values."""
    return df.select([
        F.when(F.isnan(f.name), None).otherwise(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


def upper_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def present(df: DataFrame, keys: Sequence[str], wanted: Iterable[str]) -> DataFrame:
    """Keep the keys and those wanted columns that exist."""
    have = set(df.columns)
    return df.select(*keys, *[c for c in wanted if c in have])


def with_record_key(df: DataFrame, year: str, number: str = "SEQN") -> DataFrame:
    return (df.withColumn("record_id", F.concat(F.lit(f"{year}_"),
                                                F.col(number).cast("long").cast("string")))
            .withColumn("cycle_year", F.lit(year)))


def read_cycle_file(spark: SparkSession, path: str) -> DataFrame | None:
    """One panel file (parquet, CSV or SAS transport); ``None`` if it is missing."""
    try:
        if path.endswith(".csv"):
            df = spark.read.csv(path, header=True, inferSchema=True)
        elif path.endswith(".xpt"):
            df = read_transport(spark, path)
        else:
            df = spark.read.parquet(path)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return nan_to_null(upper_header(df))


def read_transport(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """SAS transport files, decoded on executors with one task per file.

    Without ``columns`` the header of one file is read to name them; all columns
    come back as doubles.
    """
    import io

    import pandas as pd

    files = spark.read.format("binaryFile").load(path)
    if columns is None:
        head = files.limit(1).mapInPandas(
            lambda it: (pd.DataFrame({"cols": [list(next(pd.read_sas(
                io.BytesIO(b), format="xport", chunksize=1)).columns)]})
                for pdf in it for b in pdf["content"]), "cols array<string>").first()
        columns = head["cols"]
    cols = list(columns)

    def decode(batches):
        for pdf in batches:
            for blob in pdf["content"]:
                for part in pd.read_sas(io.BytesIO(blob), format="xport", chunksize=50_000):
                    yield part.reindex(columns=cols).astype("float64")

    return files.select("content").mapInPandas(decode, ", ".join(f"`{c}` double" for c in cols))


def outer_fold(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer equi-join of all frames on ``keys``, left to right."""
    return reduce(lambda a, b: a.join(b, on=list(keys), how="full"), frames)


def stack_cycles(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of cycles whose columns differ; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def load_cycles(spark: SparkSession, cycles: Sequence[dict], root: str, bases: dict[str, str],
                features: Sequence[str], side_columns: Sequence[str] = (),
                validation: dict[str, tuple[str, Sequence[str]]] | None = None,
                suffix: str = ".parquet") -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Read and merge panel files of several cycles.

    ``bases`` maps panel name to file base; the panel ``demographics`` supplies
    ``side_columns`` and is never a feature source. Missing files are skipped.
    Returns the feature table, the demographics table and the validation table.
    """
    keys = ["record_id", "cycle_year"]
    labs, demos, vals = [], [], []
    for cycle in cycles:
        def load(base: str, cycle=cycle) -> DataFrame | None:
            name = f"{root}/{cycle.get('prefix', '')}{base}{cycle.get('suffix', '')}{suffix}"
            df = read_cycle_file(spark, name)
            return None if df is None else with_record_key(df, cycle["year"])

        panels = {name: df for name, base in bases.items() if (df := load(base)) is not None}
        if not panels:
            continue
        lab = [present(df, keys, features) for name, df in panels.items() if name != "demographics"]
        if lab:
            labs.append(outer_fold(lab, keys))
        if "demographics" in panels:
            demos.append(present(panels["demographics"], keys, side_columns))
        extra = [present(df, ["record_id"], cols)
                 for base, cols in (validation or {}).values() if (df := load(base)) is not None]
        if extra:
            vals.append(outer_fold(extra, ["record_id"]))
    if not labs:
        raise FileNotFoundError(f"no panel file of any cycle under {root}")
    lab_all = stack_cycles(labs)
    demo_all = stack_cycles(demos) if demos else lab_all.select(*keys).limit(0)
    return lab_all, demo_all, stack_cycles(vals) if vals else None


def attach_context(lab: DataFrame, demographics: DataFrame | None,
                   validation: DataFrame | None) -> DataFrame:
    """Left-join demographics on both keys and validation columns on the record."""
    out = lab
    if demographics is not None:
        out = out.join(demographics, ["record_id", "cycle_year"], "left")
    if validation is not None:
        out = out.join(validation, "record_id", "left")
    return out


def read_scoring_csv(spark: SparkSession, path: str, features: Sequence[str]) -> DataFrame:
    """Records to score: header upper-cased, absent features added as NULL."""
    raw = upper_header(spark.read.csv(path, header=True))
    return nan_to_null(raw.select(*[c for c in raw.columns if c not in features],
                                  *[(F.expr(f"try_cast(`{f}` AS double)") if f in raw.columns
                                     else F.lit(None).cast("double")).alias(f) for f in features]))


def missing_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Expected names that the frame lacks, one row each."""
    spark = df.sparkSession
    want = spark.createDataFrame([(c,) for c in expected], "column_name string")
    have = spark.createDataFrame([(c,) for c in df.columns], "column_name string")
    return want.exceptAll(have)


def missing_values(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """``column_name, n_missing``: NULLs of each expected column in one scan; a column that the frame lacks misses in every row."""
    have = set(df.columns)
    counts = df.agg(F.array(*[F.struct(F.lit(c).alias("column_name"), (F.count_if(F.col(c).isNull()) if c in have else F.count(F.lit(1))).alias("n_missing"))
                              for c in expected]).alias("c"))
    return counts.select(F.explode("c").alias("c")).select("c.*")


def split_bad_rows(df: DataFrame, is_good: Column, name: str = "good") -> DataFrame:
    """Tag rows as readable or not; NULL verdicts count as unreadable."""
    return df.withColumn(name, F.coalesce(is_good, F.lit(False)))


def first_failures(df: DataFrame, is_good: Column, by: Sequence[str], key: str, n: int) -> DataFrame:
    """Quarantine: the rows that fail the check (a NULL verdict fails), the first ``n`` of each group by key, with ``rank``."""
    return top_k(df.filter(~F.coalesce(is_good, F.lit(False))), by, [F.col(key)], n)


def image_catalogue(spark: SparkSession, root: str, classes: Sequence[str] | None = None) -> DataFrame:
    """Files under ``root/<class>/`` with a class id from the sorted class names.

    Only file metadata is read. The class table has one row per folder, so the
    ranking over it is small by construction; ``image_id`` numbers the files by (class, path).
    """
    from pyspark.sql import Window

    from tessera.session import small_side

    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", "length")
             .withColumn("class_name", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1))
             .filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES)))
    if classes is not None:
        files = files.filter(F.col("class_name").isin(*classes))
    ids = (files.select("class_name").distinct()
           .withColumn("label", (F.dense_rank().over(Window.orderBy("class_name")) - 1).cast("int")))
    named = files.join(small_side(ids), "class_name").select("path", "length", "label", "class_name")
    return number_rows(named, ["label", "path"], "image_id")


def label_rows(df: DataFrame, json_col: str, included_only: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Label dictionary (JSON text) -> one row per key, with the columns to ``keep``.

    Blank and excluded entries are dropped unless asked for; ``include`` and
    ``confidence`` get their defaults and labels are trimmed.
    """
    rows = (df.select(*keep, F.explode(F.from_json(json_col, LABEL_SCHEMA)).alias("key", "meta"))
            .select(*keep, "key", F.trim("meta.label").alias("label"),
                    F.coalesce("meta.include", F.lit(True)).alias("include"),
                    F.coalesce("meta.confidence", F.lit(2)).alias("confidence"),
                    F.coalesce("meta.notes", F.lit("")).alias("notes")))
    if included_only:
        rows = rows.filter(F.col("include") & (F.col("label") != ""))
    return rows


def read_label_dictionary(spark: SparkSession, path: str, included_only: bool = True) -> DataFrame:
    return label_rows(spark.read.text(path, wholetext=True), "value", included_only)


def fetch_manifest(cycles: DataFrame, bases: DataFrame) -> DataFrame:
    """File name and address of every (cycle, file base).

    ``cycles`` holds year, suffix and an array-typed list of bases is built from
    the base frame as a scalar, so no product of two frames is planned.
    """
    listed = bases.agg(F.array_sort(F.collect_set("base")).alias("b")).scalar()
    return (cycles.withColumn("base", F.explode(listed))
            .withColumn("file_name", F.concat("base", "suffix", F.lit(".xpt")))
            .withColumn("url", F.concat_ws("/", F.regexp_replace("url_base", "/+$", ""), "file_name"))
            .select("year", "base", "file_name", "url"))
