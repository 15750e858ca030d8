"""Views that help a person (or a language model) to name clusters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.bands import one_decimal, severity_band, short_name
from tessera.functions.grid import centre_distance
from tessera.functions.vectors import l2_normalize
from tessera.operators.ordering import top_k
from tessera.operators.vectors import mean_vectors, own_similarity
from tessera.session import small_side

# Cluster labels that mean "nothing to see".
NOISE_LABELS = ("noise", "background", "bg", "—", "")

# Answer keys asked of a language model.
ANSWER_KEYS = ("PRIMARY_LABEL", "CONFIDENCE", "KEY_FINDINGS", "DIFFERENTIALS", "SME_NOTE")

# Headings of the profile sections, in print order.
SECTIONS = {
    "significantly_high": "SIGNIFICANTLY ELEVATED",
    "mildly_high": "MILDLY ELEVATED",
    "significantly_low": "SIGNIFICANTLY LOW",
    "mildly_low": "MILDLY LOW",
}

# Formats of the profile text.
PROFILE_HEAD = ("Cluster of ", " patients with the following lab pattern:\n")
PROFILE_LINE = ("    • ", "  (deviation ", " from normal midpoint)")
PROFILE_NORMAL = "\n  WITHIN NORMAL RANGE: "


PROMPT_HEAD = "The following laboratory pattern describes one cluster of records that was found without using any diagnosis.\n\n"
PROMPT_TAIL = ("\n\nName the pattern with a short snake_case label, state how confident you are (high, medium or low), say which findings "
               "decided it, list alternatives and add one sentence for the reviewing expert.\nAnswer with a JSON object with the keys ")


def representatives(df: DataFrame, by: Sequence[str], vec: str, row_id: str, k: int = 10) -> DataFrame:
    """The ``k`` rows of each cluster closest to its mean direction, with their rank."""
    cluster = by[0] if len(by) == 1 else "_cluster"
    if len(by) > 1:
        df = df.withColumn(cluster, F.concat_ws(":", *by))
    sims = own_similarity(df, vec, cluster, mean_vectors(df, [cluster], vec))
    best = top_k(sims, list(by), [F.col("similarity").desc(), F.col(row_id)], k)
    return best.select(*by, row_id, "rank", F.round("similarity", 3).alias("similarity"))


def ranked_lookup(ranked: DataFrame, table: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """Rows of ``table`` for a ranked id list, in rank order."""
    return ranked.join(table, key).orderBy(rank)


def core_and_boundary(df: DataFrame, cluster: str, vec: str, row_id: str, n: int = 9,
                      quality: Column | None = None) -> DataFrame:
    """Most and least typical rows of each cluster among those of good quality.

    ``max(6, n - 3)`` core rows by similarity to the mean of the whole cluster; the
    other ``n`` minus that are the least similar rows, if the pool is larger than
    the core. A row may be both. Similarities are computed once; each row competes
    from both ends and is cut before the shuffle. One row beyond the core tells
    whether the pool is larger.
    """
    n_core = max(6, n - 3)
    n_edge = max(0, n - n_core)
    sims = own_similarity(df, vec, cluster, mean_vectors(df, [cluster], vec))
    good = sims if quality is None else sims.filter(quality)
    ends = good.select(cluster, row_id, "similarity", F.explode(F.array(F.lit(False), F.lit(True))).alias("is_boundary"))
    edge = F.col("is_boundary")
    order = [F.when(edge, -F.col("similarity")).otherwise(F.col("similarity")).desc(),
             F.when(~edge, F.col(row_id)).asc(), F.when(edge, F.col(row_id)).desc()]
    best = top_k(ends, [cluster, "is_boundary"], order, max(n_core + 1, n_edge))
    reach = F.max(F.when(~edge, F.col("rank"))).over(Window.partitionBy(cluster))
    best = best.withColumn("_reach", reach)
    keep = F.when(edge, (F.col("rank") <= n_edge) & (F.col("_reach") > n_core)).otherwise(F.col("rank") <= n_core)
    return best.filter(keep).select(cluster, row_id, "similarity", "rank", "is_boundary")


def class_distribution(df: DataFrame, cluster: str, label: str, classes: Sequence,
                       mixed_below: float = 0.70) -> DataFrame:
    """Class fractions per cluster, the dominant class and whether it is mixed.

    ``classes`` is in priority order: the first of equally frequent classes dominates.
    Rows without a class count among the cluster's rows.
    """
    share = [(F.count_if(F.col(label) == c) / F.count(F.lit(1))).alias(f"frac_{c}") for c in classes]
    out = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *share)
    names = F.array(*[F.lit(str(c)) for c in classes])
    fracs = F.array(*[F.col(f"frac_{c}") for c in classes])
    top = F.array_max(fracs)
    return (out.withColumn("dominant", names[F.array_position(fracs, top).cast("int") - 1])
            .withColumn("is_mixed", top < mixed_below))


def distinctiveness(centres: DataFrame, key: str, vec: str = "vector") -> DataFrame:
    """Foreground score: distance from the other centres, and length.

    The mean cosine to the others is the product with the sum of all unit centres
    minus the centre's own 1 (0 for a zero centre), so no pair of centres is formed.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from tessera.functions.vectors import vector_norm

    units = small_side(centres).select(key, F.col(vec), l2_normalize(vec).alias("_u"))
    total = units.agg(vector_to_array(Summarizer.sum(array_to_vector("_u"))).alias("s"),
                      F.count(F.lit(1)).alias("k")).select(F.struct("s", "k")).scalar()
    dot = F.aggregate(F.zip_with("_u", F.col("_t.s"), lambda a, b: a * b), F.lit(0.0),
                      lambda acc, x: acc + x)
    return (units.withColumn("_t", total)
            .withColumn("distinctiveness", 1.0 - (dot - (vector_norm(vec) > 0).cast("double")) / F.col("_t.k"))
            .withColumn("fg_score", F.col("distinctiveness") * 0.6
                        + F.least(vector_norm(vec) / 10.0, F.lit(1.0)) * 0.4)
            .drop("_u", "_t", vec))


def spatial_means(df: DataFrame, cluster: str, patch: str, grid: int,
                  clusters: DataFrame | None = None) -> DataFrame:
    """Mean distance of a cluster's patches to the grid centre; 1 for an empty one."""
    out = df.groupBy(cluster).agg(F.avg(centre_distance(patch, grid)).alias("mean_distance"))
    if clusters is not None:
        out = clusters.join(out, cluster, "left").fillna(1.0, subset=["mean_distance"])
    return out


def cluster_sizes(df: DataFrame, cluster: str, clusters: DataFrame | None = None,
                  min_size: int = 50) -> DataFrame:
    """Rows and share per cluster, zero-filled by a cluster table if given."""
    out = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    if clusters is not None:
        out = clusters.join(out, cluster, "left").fillna(0, subset=["n"])
    total = Window.partitionBy()
    return (out.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(total)))
            .withColumn("large_enough", F.col("n") > min_size))


def cluster_order(clusters: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Named clusters first, by name; noise and unnamed ones last, by id.

    One row per cluster, so a single ordered pass is small. Adds ``position``,
    ``is_noise`` and ``next_unlabelled`` (the lowest id without a name).
    """
    text = F.lower(F.trim(F.coalesce(F.col(label), F.lit(""))))
    d = clusters.withColumn("is_noise", text.isin(*NOISE_LABELS))
    order = Window.orderBy("is_noise", F.when(~F.col("is_noise"), F.lower(label)), key)
    whole = Window.partitionBy()
    return (d.withColumn("position", F.row_number().over(order).cast("long"))
            .withColumn("next_unlabelled",
                        F.min(F.when(F.trim(F.coalesce(F.col(label), F.lit(""))) == "", F.col(key))).over(whole)))


def deviation_profile(df: DataFrame, cluster: str, features: Sequence[str],
                      labels: Mapping[str, str] | None = None) -> DataFrame:
    """Mean deviation of each feature per cluster and against all records, banded.

    Sums are taken on the wide table (one row per cluster leaves the aggregation);
    only those few rows are turned to long form, and their total gives the
    population mean.
    """
    labels = labels or {}
    sums = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_records"),
                                   *[F.sum(f).alias(f) for f in features],
                                   *[F.count(f).alias(f"_n_{f}") for f in features])
    cells = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f).alias("code"),
                               F.lit(labels.get(f, f)).alias("name"), F.col(f).alias("s"),
                               F.col(f"_n_{f}").alias("n")) for i, f in enumerate(features)])
    rows = sums.select(cluster, "n_records", F.explode(cells).alias("_cell")).select(cluster, "n_records", "_cell.*")
    whole = Window.partitionBy("code")
    rows = rows.withColumn("dev", F.try_divide("s", "n")).withColumn(
        "pop", F.try_divide(F.sum("s").over(whole), F.sum("n").over(whole)))
    return rows.select(cluster, "n_records", "ord", "code", short_name("name").alias("label"),
                       F.round("dev", 2).alias("deviation"),
                       F.round(F.col("dev") - F.col("pop"), 2).alias("vs_pop"),
                       severity_band("dev").alias("band"))


def profile_text(profile: DataFrame, cluster: str, max_normal: int = 6) -> DataFrame:
    """Readable summary of each cluster's profile, strongest deviations first.

    A cluster has one row per configured feature, so its list stays short.
    """
    def lines(band: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("band") == band, F.struct(
            (-F.abs("deviation")).alias("k"), F.col("ord"), F.concat(
                F.lit(PROFILE_LINE[0]), F.col("label"), F.lit(PROFILE_LINE[1]),
                one_decimal(F.col("deviation"), signed=True), F.lit(PROFILE_LINE[2])).alias("t")))))
        body = F.concat_ws("\n", F.transform(rows, lambda r: r["t"]))
        return F.when(body != "", F.concat(F.lit(f"  {SECTIONS[band]}:\n"), body))

    normal = F.transform(F.array_sort(F.collect_list(F.when(
        F.col("band") == "normal", F.struct("ord", "label")))), lambda r: r["label"])
    grouped = profile.groupBy(cluster).agg(
        F.first("n_records").alias("n_records"), normal.alias("_normal"),
        *[lines(b).alias(f"_{b}") for b in SECTIONS])
    more = F.when(F.size("_normal") > max_normal,
                  F.concat(F.lit(", +"), (F.size("_normal") - max_normal).cast("string"), F.lit(" more")))
    listed = F.concat(F.array_join(F.slice("_normal", 1, max_normal), ", "), F.coalesce(more, F.lit("")))
    tail = F.when(F.size("_normal") > 0, F.concat(F.lit(PROFILE_NORMAL), listed))
    head = F.concat(F.lit(PROFILE_HEAD[0]), F.col("n_records").cast("string"), F.lit(PROFILE_HEAD[1]))
    return grouped.select(cluster, F.concat_ws("\n", head, *[F.col(f"_{b}") for b in SECTIONS],
                                               tail).alias("profile"))


def label_prompt(profile: str | Column = "profile") -> Column:
    """Question to a language model about one profile, answerable as JSON."""
    body = F.col(profile) if isinstance(profile, str) else profile
    keys = ", ".join(ANSWER_KEYS)
    return F.concat(F.lit(PROMPT_HEAD), body, F.lit(f"{PROMPT_TAIL}{keys}."))


def parse_answer(text: str | Column) -> Column:
    """JSON answer of a language model -> struct; ``error`` is set if it is malformed.

    A Markdown fence, with or without a language tag, is removed first.
    """
    raw = F.col(text) if isinstance(text, str) else text
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?(.*?)(?:```|$)", 1)
    body = F.trim(F.when(F.contains(raw, F.lit("```")), fenced).otherwise(raw), F.lit(" \t\r\n"))
    schema = ", ".join(f"{k} string" for k in ANSWER_KEYS) + ", _corrupt string"
    got = F.from_json(body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    bad = got.isNull() | got.getField("_corrupt").isNotNull() | ~F.startswith(body, F.lit("{"))
    return F.struct(*[F.when(~bad, got.getField(k)).alias(k) for k in ANSWER_KEYS],
                    F.when(bad, F.lit("unparsable answer")).alias("error"))


def ranked_probabilities(probabilities: str | Column, classes: Sequence[str]) -> Column:
    """Classes with their probability, the likeliest first; equal ones in the order of ``classes``."""
    probs = F.col(probabilities) if isinstance(probabilities, str) else probabilities
    names = F.array(*[F.lit(c) for c in classes])
    cells = F.transform(probs, lambda p, i: F.struct((-p).alias("k"), i.alias("i")))
    return F.transform(F.array_sort(cells), lambda c: F.struct(F.element_at(names, c["i"] + 1).alias("class"), (-c["k"]).alias("probability")))


def activation_sentence(rows: DataFrame, entity: str, threshold: float = 0.5, k: int = 3) -> DataFrame:
    """Up to ``k`` strongest concepts above the threshold, as one phrase per entity."""
    best = top_k(rows.filter(F.col("score") > threshold), [entity],
                 [F.col("score").desc(), F.col("concept")], k)
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "concept"))),
                        lambda r: F.replace(r["concept"], F.lit("_"), F.lit(" ")))
    return best.groupBy(entity).agg(F.array_join(names, ", ").alias("sentence"))
