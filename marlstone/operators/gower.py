"""Gower distance without pairs: silhouettes and medoids of all rows from sums over single features.

The distance is a mean over features of |difference| / range, or of mismatch for codes; what is unknown differs from nothing.
So the sum of a row's distances to a cluster is a sum over features of a function of the row's value alone:

    number:  v * (2 * N(v) - N) - (2 * S(v) - S)    N(v), S(v): count and sum of the cluster's values up to v
    code:    N - n(v)                               n(v): rows of the cluster with that code

Counts by value combine before the shuffle, prefix sums over the values are laid over ranges (`panel.running_totals`), and
rows meet their values' sums in one join for each feature, which Catalyst broadcasts where the distinct values are
few and AQE splits where one value holds many rows. Work grows with rows x features x clusters, never with pairs.

Groupings to be compared (numbers of clusters, say) are rows of one frame with a `setting`, handled in the same jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.operators import centres, panel
from marlstone.sources import tables


def scaled_rows(rows: DataFrame, key: str, numbers: list[str], codes: list[str]) -> DataFrame:
    """key, numbers brought to [0, 1] by their ranges (NULL without a range), codes as text: a written table."""
    ends = rows.agg(*(F.struct(F.min(c).cast("double").alias("a"), F.max(c).cast("double").alias("b")).alias(c) for c in numbers)).first()
    scaled = [E.ratio(F.col(c).cast("double") - F.lit(ends[c].a), F.lit(ends[c].b) - F.lit(ends[c].a)).alias(c) for c in numbers]
    return tables.spread(rows.select(key, *scaled, *(F.col(c).cast("string").alias(c) for c in codes)), "scaled", key)


def _per_value(labelled: DataFrame, by: list[str], numbers: list[str], codes: list[str], k: int) -> tuple[DataFrame, DataFrame]:
    """by, feature, value, d: sums of differences of each value to the k clusters, for numbers and for codes."""
    names = [f"c{j}" for j in range(k)]

    def counted(features: list[str], kind: str) -> DataFrame:
        entries = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("value")) for c in features)).cast(f"array<struct<feature:string,value:{kind}>>")
        long = labelled.select(*by, "label", F.explode(entries).alias("e")).select(*by, "label", "e.*").where("value IS NOT NULL")
        return long.groupBy(*by, "feature", "value").agg(*(F.count_if(F.col("label") == j).cast("double").alias(n) for j, n in enumerate(names)))

    code = counted(codes, "string")
    known = code.groupBy(*by, "feature").agg(*(F.sum(n).alias(f"t_{n}") for n in names))
    code = code.join(known, [*by, "feature"]).select(*by, "feature", "value", F.array(*(F.col(f"t_{n}") - F.col(n) for n in names)).alias("d"))

    number = counted(numbers, "double").withColumns({f"s{n}": F.col(n) * F.col("value") for n in names})
    sums = [*names, *(f"s{n}" for n in names)]
    run = panel.running_totals(tables.kept(number, "values"), [*by, "feature"], "value", sums)
    gap = [F.col("value") * (2 * F.col(f"run_{n}") - F.col(f"all_{n}")) - (2 * F.col(f"run_s{n}") - F.col(f"all_s{n}")) for n in names]
    return tables.kept(run.select(*by, "feature", "value", F.array(*gap).alias("d")), "number-sums"), tables.kept(code, "code-sums")


def cluster_totals(labelled: DataFrame, by: list[str], key: str, numbers: list[str], codes: list[str], k: int) -> DataFrame:
    """by, key, label, totals: the sum of each row's distances to the rows of each of the clusters 0..k-1 of its group.

    labelled: by, key, label and the columns of `scaled_rows`. A written table.
    """
    number, code = _per_value(labelled, by, numbers, codes, k)
    none = F.array_repeat(F.lit(0.0), k)
    own, parts = labelled, []
    for i, c in enumerate([*numbers, *codes]):
        table = (number if c in numbers else code).where(F.col("feature") == c)
        own = own.join(table.select(*by, F.col("value").alias(c), F.col("d").alias(f"d{i}")), [*by, c], "left")
        parts.append(F.coalesce(F.col(f"d{i}"), none))
    total = parts[0]
    for p in parts[1:]:
        total = F.zip_with(total, p, lambda a, b: a + b)
    return tables.kept(own.select(*by, key, "label", E.scaled(total, F.lit(1.0 / len(parts))).alias("totals")), "totals")


def silhouettes(labelled: DataFrame, by: list[str], key: str, numbers: list[str], codes: list[str], k: int) -> DataFrame:
    """by, key, label, silhouette of every row: 0 for a row alone in its cluster, and where there is one cluster only."""
    totals = cluster_totals(labelled, by, key, numbers, codes, k)
    sizes = labelled.groupBy(*by).agg(F.array(*(F.count_if(F.col("label") == j).cast("double") for j in range(k))).alias("sizes"))
    own = totals.join(F.broadcast(sizes), by) if by else totals.crossJoin(F.broadcast(sizes))  # a row for each group
    size = F.get("sizes", F.col("label"))
    a = E.ratio(F.get("totals", F.col("label")), size - 1)
    means = F.transform("totals", lambda t, j: F.when((j != F.col("label")) & (F.get("sizes", j) > 0), t / F.get("sizes", j)))
    b = F.array_min(means)
    value = F.when((size < 2) | b.isNull(), 0.0).otherwise(F.coalesce(E.ratio(b - a, F.greatest(a, b)), F.lit(0.0)))
    return own.select(*by, key, "label", value.alias("silhouette"))


def _distance(numbers: list[str], codes: list[str], to: Column) -> Column:
    """Distance of a row to a struct of the same columns."""
    parts = [F.abs(F.col(c) - to[c]) for c in numbers] + [(F.col(c) != to[c]).cast("double") for c in codes]
    return E.total(F.coalesce(p, F.lit(0.0)) for p in parts) / len(parts)


def assigned(rows: DataFrame, medoids: DataFrame, key: str, numbers: list[str], codes: list[str]) -> DataFrame:
    """setting, label, distance and the rows' columns: every row at its nearest medoid of each setting, the first on ties.

    medoids: setting, label and the columns of a row; a few rows, chosen on the driver, sent to the tasks.
    """
    held = medoids.groupBy("setting").agg(F.array_sort(F.collect_list(F.struct("label", *numbers, *codes))).alias("medoids"))
    near = F.array_min(F.transform("medoids", lambda m: F.struct(_distance(numbers, codes, m).alias("distance"), m["label"].alias("label"))))
    return rows.crossJoin(F.broadcast(held)).withColumn("near", near).select("setting", key, *numbers, *codes, "near.label", "near.distance")  # a row a setting


def _uniform(key: str, *salt: int) -> Column:
    """A number in (0, 1] by hash."""
    return (F.pmod(F.xxhash64(F.col(key), *(F.lit(s) for s in salt)), F.lit(1 << 52)) + 1) / float(1 << 52)


def _central(rows: DataFrame, own: centres.Coded | None, medoids: dict, ends: list, key: str, numbers: list[str], codes: list[str]) -> dict:
    """The row of least total distance to the cluster of each medoid: from counts, or by joins where codes have very many values."""
    if own is not None:
        return centres.central(own, medoids, ends)
    columns = [key, *numbers, *codes]
    held = rows.sparkSession.createDataFrame([(*at, *row) for at, row in medoids.items()], _schema(rows))
    found = tables.kept(assigned(rows, held, key, numbers, codes).drop("distance").withColumnRenamed("label", "cluster").withColumn("label", F.lit(0)), "assigned")
    totals = cluster_totals(found, ["setting", "cluster"], key, numbers, codes, 1)
    best = totals.groupBy("setting", "cluster").agg(F.min(F.struct(F.round(F.get("totals", F.lit(0)), 9).alias("t"), key)).alias("x"))
    least = F.broadcast(best.select("setting", "cluster", f"x.{key}"))  # a row for each medoid
    return {(r.setting, r.cluster): tuple(r[c] for c in columns) for r in found.join(least, ["setting", "cluster", key]).collect()}


def _schema(rows: DataFrame) -> str:
    return f"setting int, label int, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}"


def _seeds(rows: DataFrame, own: centres.Coded | None, ends: list, key: str, numbers: list[str], codes: list[str], k: int, seed: int) -> list:
    """k rows: the most central one, then each drawn by its squared distance to the nearest before it.

    The draw is the least of exponential times -ln(u) / d**2 with u by hash: one aggregation, no weights on the driver.
    """
    some = rows.first()
    if some is None:
        return []
    (middle,) = _central(rows, own, {(0, 0): tuple(some)}, ends, key, numbers, codes).values()
    picked = [middle]
    while len(picked) < k:
        held = rows.sparkSession.createDataFrame(picked, rows.schema).withColumns({"setting": F.lit(0), "label": F.lit(0)})
        far = assigned(rows, held, key, numbers, codes).where("distance > 0")
        draw = -F.ln(_uniform(key, seed, len(picked))) / F.pow("distance", 2)
        found = far.agg(F.min(F.struct(draw.alias("draw"), F.struct(*(rows.columns)).alias("row"))).alias("x")).first().x
        if found is None:  # fewer different rows than k
            break
        picked.append(found.row)
    return picked


def medoids(rows: DataFrame, key: str, numbers: list[str], codes: list[str], ks: list[int], steps: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Medoids of each number of clusters in ks (setting, label, columns of the scaled row), and the scaled rows.

    All rows count in every step: each goes to its nearest medoid, then the row of least total distance to its
    cluster (ties: the smaller key) becomes its medoid, for all settings in the same jobs, until none moves. Only
    medoids come to the driver.
    """
    scaled = scaled_rows(rows, key, numbers, codes)
    found, _ = _medoids(scaled, key, numbers, codes, ks, steps, seed)
    return rows.sparkSession.createDataFrame([(*at, *row) for at, row in found.items()], _schema(scaled)), scaled


def _medoids(scaled: DataFrame, key: str, numbers: list[str], codes: list[str], ks: list[int], steps: int, seed: int = 42) -> tuple[dict, centres.Coded | None]:
    """(setting, label) to the medoid's key, numbers and codes; and the table they were found on."""
    own = centres.coded(scaled, key, numbers, codes)
    ends = centres.edges(own, centres.SEARCH_EDGES) if own is not None else []
    seeds = _seeds(scaled, own, ends, key, numbers, codes, max(ks), seed)
    now = {(k, i): tuple(r) for k in ks for i, r in enumerate(seeds[:k])}
    moving = set(ks) if now else set()
    for _ in range(steps):
        if not moving:
            break
        new = _central(scaled, own, {at: row for at, row in now.items() if at[0] in moving}, ends, key, numbers, codes)
        moving = {at[0] for at, row in new.items() if now[at] != row}
        now |= new
    return now, own


def k_medoids(rows: DataFrame, key: str, numbers: list[str], codes: list[str], k: int, steps: int = 20) -> DataFrame:
    """key, label, distance: every row at its nearest medoid."""
    found, scaled = medoids(rows, key, numbers, codes, [k], steps)
    return assigned(scaled, found, key, numbers, codes).select(key, "label", "distance")


def medoid_counts(rows: DataFrame, key: str, numbers: list[str], codes: list[str], ks: list[int], steps: int = 20) -> DataFrame:
    """k, silhouette, inertia, best: mean silhouette and sum of distances over all rows for each number of medoids.

    best marks the greatest silhouette, the smaller k on ties.
    """
    scaled = scaled_rows(rows, key, numbers, codes)
    found, coded = _medoids(scaled, key, numbers, codes, ks, steps)
    order = Window.partitionBy().orderBy(F.desc(F.round("silhouette", 12)), "k")  # a row for each k
    if coded is not None:
        sums = centres.silhouette_sums(coded, found) if found else []
        return rows.sparkSession.createDataFrame(sums, "k int, silhouette double, inertia double").withColumn("best", F.row_number().over(order) == 1)
    own = tables.kept(assigned(scaled, rows.sparkSession.createDataFrame([(*at, *row) for at, row in found.items()], _schema(scaled)), key, numbers, codes), "final")
    each = silhouettes(own.drop("distance"), ["setting"], key, numbers, codes, max(ks))
    means = each.groupBy("setting").agg(F.avg("silhouette").alias("silhouette"))
    inertia = own.groupBy("setting").agg(F.sum("distance").alias("inertia"))
    return means.join(inertia, "setting").withColumnRenamed("setting", "k").withColumn("best", F.row_number().over(order) == 1)
