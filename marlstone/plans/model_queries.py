"""Queries on models that learn from moments, folds and gradients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.operators import autoencoder, backtest, learn, metrics, mixture, panel, prototypes, recommend, risk, segment, statespace, warning
from marlstone.plans import client_queries, frames
from marlstone.plans.registry import query
from marlstone.sources import tables

_R = E.rounded
N = frames.NAMES
#: Series whose returns stand for the regime: components of the target.
REGIME = ["O", "F"]


def _regime_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replication rows with the returns of the regime's series."""
    date = F.date_trunc("week", "o_orderdate").cast("date").alias("date")
    parts = frames.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("asset"), date).agg(F.avg("o_totalprice").alias("price"))
    regime = panel.wide(panel.return_panel(parts), "asset", REGIME, "r", "")
    return frames.replication(spark, sf_dir).join(regime, "date", "left")


def _window(k: int, age: int = 1) -> str:
    """The k rows up to `age` rows before."""
    return f"OVER (ORDER BY k ROWS BETWEEN {k + age - 1} PRECEDING AND {age} PRECEDING)"


def _eliminated(n: int, start: str) -> str:
    """CTEs g1..gn that solve the n equations m_i_0..m_i_n of a table row by row."""
    steps, source = [], start
    for p in range(n):
        row = [f"m_{p}_{j} / m_{p}_{p} AS m_{p}_{j}" for j in range(p + 1, n + 1)]
        others = [f"m_{i}_{j} - m_{i}_{p} * m_{p}_{j} / m_{p}_{p} AS m_{i}_{j}" for i in range(n) if i != p for j in range(p + 1, n + 1)]
        steps.append(f"g{p + 1} AS MATERIALIZED (SELECT k, {', '.join(row + others)} FROM {source})")
        source = f"g{p + 1}"
    return ",\n".join(steps)


def _ridge_sql(names: list[str], window: int, age: int, alpha: float, scaled: bool) -> str:
    """CTEs from f (k, names, y) to ridge (k, w0..): coefficients on `window` rows up to `age` before, times the ranges if scaled."""
    n = len(names)
    ends = ", ".join(f"min({c}) {_window(window, age)} AS lo_{c}, max({c}) {_window(window, age)} - min({c}) {_window(window, age)} AS sp_{c}" for c in names)

    def x(c: str) -> str:
        return f"((a.{c} - lo_{c}) / sp_{c})" if scaled else f"a.{c}"

    cells = [f"sum({x(names[min(i, j)])} * {x(names[max(i, j)])}) + {alpha if i == j else 0}::DOUBLE AS m_{i}_{j}" for i in range(n) for j in range(n)]
    cells += [f"sum({x(c)} * a.y) AS m_{i}_{n}" for i, c in enumerate(names)]
    back = ", ".join(f"m_{i}_{n}{f' * sp_{c}' if scaled else ''} AS w{i}" for i, c in enumerate(names))
    return f"""ends AS (SELECT k, {ends} FROM f),
g0 AS MATERIALIZED (SELECT e.k, {", ".join(cells)} FROM ends e JOIN f a ON a.k BETWEEN e.k - {window + age - 1} AND e.k - {age} GROUP BY e.k HAVING count(*) = {window}),
{_eliminated(n, "g0")},
ridge AS (SELECT g{n}.k, {back} FROM g{n} JOIN ends ON ends.k = g{n}.k)"""


def _features_sql() -> str:
    def full(value: str, c: str, k: int) -> str:
        return f"CASE WHEN count({c}) {_window(k)} = {k} THEN round({value}, 6) END"

    made = {f"ret_{k}w_{c}": full(f"product(1 + {c}) {_window(k)} - 1", c, k) for k in (4, 12, 52) for c in N}
    made |= {f"vol_{k}w_{c}": full(f"stddev_samp({c}) {_window(k)} * sqrt(52)", c, k) for k in (12, 52) for c in N}
    made |= {f"regime_{c}_12w": full(f"product(1 + {c}) {_window(12)} - 1", c, 12) for c in REGIME}
    made["regime_target_vol_12w"] = full(f"stddev_samp(y) {_window(12)} * sqrt(52)", "y", 12)
    warm = ", ".join(f"round(w{i}, 6) AS warm_{c}" for i, c in enumerate(N))
    return f"""WITH {frames.REPLICATION}, regime AS (SELECT date, {", ".join(f"max(r) FILTER (WHERE asset = '{c}') AS {c}" for c in REGIME)} FROM compr GROUP BY date),
f AS MATERIALIZED (SELECT rep.*, {", ".join(REGIME)}, row_number() OVER (ORDER BY date) - 1 AS k FROM rep LEFT JOIN regime USING (date)),
{_ridge_sql(N, 52, 2, 1e-3, True)},
u AS (SELECT date, k, {", ".join(f"{v} AS {c}" for c, v in made.items())} FROM f)
SELECT date, {", ".join(made)}, {warm} FROM u JOIN ridge USING (k) WHERE ret_52w_r0 IS NOT NULL AND regime_O_12w IS NOT NULL AND regime_F_12w IS NOT NULL"""


@query(_features_sql())
def backtest_network_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 69 lagged features of the instruments, the regime and the warm start: what a network may know before its row."""
    own, made = learn.network_features(_regime_rows(spark, sf_dir), N, REGIME)
    return own.select("date", *(_R(c).alias(c) for c in made))


@query(f"""WITH {frames.REPLICATION}, f AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY date) - 1 AS k FROM rep), {_ridge_sql(N, 104, 1, 0.01, False)}
SELECT date, {", ".join(f"round(w{i}, 6) AS w{i}" for i in range(len(N)))} FROM f JOIN ridge USING (k)""")
def backtest_rolling_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge coefficients of all instruments on the 104 rows before every date, from differences of running moments."""
    own = backtest.rolling_ridge(frames.replication(spark, sf_dir), N, 104, 0.01, scaled=False).where("ridge IS NOT NULL")
    return own.select("date", *(_R(F.get("ridge", F.lit(i))).alias(f"w{i}") for i in range(len(N))))


@query()
def backtest_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric row of an ensemble of small networks on all features, fitted walk-forward."""
    own, features = learn.network_features(_regime_rows(spark, sf_dir), N, REGIME)
    weights = learn.network_backtest(own, features, N, window=104, every=4)
    return risk.network_metrics(backtest.evaluate_weights(own, weights, N))


#: Filters of the recursive SQL: settings and what SQL makes of them.
FILTERS = [statespace.Setting("adaptive", 1e-3, 1.0, 1.0, 0.5, True), statespace.Setting("basic")]


def _filter_sql(n: int) -> str:
    """The filters on the first n instruments by recursion over dates."""
    names, each = N[:n], range(n)
    pairs = [(i, j) for i in each for j in each if i <= j]
    p = lambda i, j: f"p_{min(i, j)}_{max(i, j)}"
    q = lambda i, j: f"q_{min(i, j)}_{max(i, j)}"
    cov = lambda i, j: f"c_{min(i, j)}_{max(i, j)}"
    whole = _window(52)
    values = ", ".join(f"('{s.name}', {s.drift}::DOUBLE, {s.noise}::DOUBLE, {s.start}::DOUBLE, {s.damping}::DOUBLE, {s.adaptive})" for s in FILTERS)
    gap = f"sqrt(greatest({' + '.join(f'v{i} * v{j} * {cov(i, j)}' for i in each for j in each)}, 0)) * {-E.normal_quantile(risk.CONFIDENCE) * 2}::DOUBLE"
    return f"""WITH RECURSIVE {frames.REPLICATION}, f AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY date) - 1 AS k FROM rep), {_ridge_sql(names, 52, 1, 1e-3, False)},
o AS MATERIALIZED (SELECT date, k, y, {", ".join(f"{c} AS x{i}" for i, c in enumerate(names))}, var_samp(y) {_window(12)} / var_samp(y) {whole} AS calm, var_samp(y) {whole} AS variance,
 {", ".join(f"covar_samp({names[i]}, {names[j]}) {whole} AS {cov(i, j)}" for i, j in pairs)} FROM f),
s(name, drift, noise, start, damping, adaptive) AS (VALUES {values}),
b AS MATERIALIZED (SELECT s.*, variance AS base, {", ".join(f"w{i} AS first{i}" for i in each)} FROM s, o JOIN ridge USING (k) WHERE k = 52),
kf AS (SELECT name, 52::BIGINT AS k, {", ".join(f"first{i} AS w{i}, first{i} AS h{i}" for i in each)}, {", ".join(f"{'start' if i == j else '0.0::DOUBLE'} AS {p(i, j)}" for i, j in pairs)} FROM b
 UNION ALL SELECT name, k + 1, {", ".join(f"w{i} + px{i} * e / sc, (1 - damping) * u{i} + damping * (w{i} + px{i} * e / sc)" for i in each)}, {", ".join(f"{q(i, j)} - px{i} * px{j} / sc" for i, j in pairs)}
 FROM (SELECT *, y - ({" + ".join(f"x{i} * w{i}" for i in each)}) AS e, {" + ".join(f"x{i} * px{i}" for i in each)} + base * noise * a AS sc FROM
 (SELECT *, {", ".join(" + ".join(f"{q(i, j)} * x{j}" for j in each) + f" AS px{i}" for i in each)} FROM
 (SELECT *, {", ".join(f"v{i} * CASE WHEN gap > 0.08::DOUBLE THEN 0.08::DOUBLE / gap ELSE 1 END AS u{i}" for i in each)}, {", ".join(f"{p(i, j)} + {'drift * drift * a' if i == j else '0'} AS {q(i, j)}" for i, j in pairs)} FROM
 (SELECT *, {gap} AS gap FROM (SELECT *, CASE WHEN adaptive THEN calm ELSE 1 END AS a, {", ".join(f"h{i} * CASE WHEN ge > 2 THEN 2 / ge ELSE 1 END AS v{i}" for i in each)} FROM
 (SELECT kf.*, b.drift, b.noise, b.damping, b.adaptive, b.base, o.y, o.calm, {", ".join(f"o.x{i}" for i in each)}, {", ".join(f"o.{cov(i, j)}" for i, j in pairs)}, {" + ".join(f"abs(h{i})" for i in each)} AS ge
 FROM kf JOIN o ON o.k = kf.k JOIN b USING (name))))))))
SELECT name AS setting, date, {", ".join(f"round(v{i} * CASE WHEN gap > 0.08::DOUBLE THEN 0.08::DOUBLE / gap ELSE 1 END, 6) AS w{i}" for i in each)} FROM
 (SELECT *, {gap} AS gap FROM (SELECT kf.name, o.*, {", ".join(f"h{i} * CASE WHEN {' + '.join(f'abs(h{j})' for j in each)} > 2 THEN 2 / ({' + '.join(f'abs(h{j})' for j in each)}) ELSE 1 END AS v{i}" for i in each)} FROM kf JOIN o USING (k)))"""


def _filters(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    found = statespace.kalman(frames.replication(spark, sf_dir), N[:n], FILTERS)
    return found.select("setting", "date", *(_R(f"w_{c}").alias(f"w{i}") for i, c in enumerate(N[:n])))


@query(_filter_sql(1))
def portfolio_kalman_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The basic and the adaptive filter on a single instrument, which recursive SQL can check."""
    return _filters(spark, sf_dir, 1)


@query(_filter_sql(2))
def portfolio_kalman_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The basic and the adaptive filter on two instruments, with damping and both caps, against recursive SQL."""
    return _filters(spark, sf_dir, 2)


@query()
def portfolio_kalman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held weights of all instruments from the basic and the adaptive filter."""
    return statespace.kalman(frames.replication(spark, sf_dir), N, FILTERS)


@query()
def portfolio_kalman_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replication scores of a grid of filters, each setting also a fifth above and below, and the best."""
    rows = frames.replication(spark, sf_dir)
    settings = statespace.grid([1e-4, 1e-3, 1e-2], [0.5, 1.0, 2.0], [0.1, 1.0])
    settings += statespace.grid([0.8e-3, 1.2e-3], [0.8, 1.2], [0.8, 1.2])
    return statespace.scores(rows, statespace.kalman(rows, N, settings), N)


def _judged_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Labelled documents with measures of their texts; the label of quality is a judgement, no formula of these."""
    text = F.coalesce("text", F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / n
    docs = frames.table(spark, sf_dir, "documents").select(
        "doc_id", F.log1p(F.length(text)).alias("size"), share("[^A-Za-z]").alias("letters"), share("[^0-9]").alias("digits"), share("[^A-Z]").alias("capitals"),
        share(r"[\p{L}\p{N}\s]").alias("marks"), share(r"\S").alias("blanks"), (F.size(F.split(text, "\n")) / n).alias("lines"),
        (F.size(F.array_distinct(F.split(text, r"\s+"))) / F.size(F.split(text, r"\s+"))).alias("variety"),
    )
    labels = frames.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")).where("label IS NOT NULL")
    return tables.kept(docs.join(labels, "doc_id"), "judged"), [c for c in docs.columns if c != "doc_id"]


@query()
def eval_stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC and F0.5 on held-out documents of stacked classifiers, and the cross-validated F0.5 of the settings searched."""
    from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier

    own, columns = _judged_documents(spark, sf_dir)
    held = F.pmod(F.crc32(F.concat(F.lit("held:"), F.col("doc_id").cast("string"))), F.lit(10)) < 3
    bases = {"logistic": lambda y: LogisticRegression(labelCol=y, regParam=0.01), "bayes": lambda y: NaiveBayes(labelCol=y, modelType="gaussian")}
    search = {f"forest_{n}_{d}": (lambda y, n=n, d=d: RandomForestClassifier(labelCol=y, numTrees=n, maxDepth=d, seed=42)) for n, d in ((10, 3), (30, 6))}
    scored, found = learn.stacked(own.where(~held), own.where(held), "label", "doc_id", columns, bases, search)
    scored = tables.kept(scored.select("label", "score"), "stacked")
    auc = metrics.roc_auc(scored, "label", "score")
    return auc.withColumn("f05", F.lit(learn.fbeta_at(scored, "label", "score"))).withColumns({f"cv_{n}": F.lit(v) for n, v in found.items()})


_FEATURES = ["age", "income", "wealth", "risk"]


@query()
def segment_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personas from a mixture of at most 15 components under a Dirichlet-process prior, profiled; clients of other components are left out."""
    own = tables.kept(segment.standardised(frames.clients(spark, sf_dir), _FEATURES), "standardised")
    posterior, _ = mixture.fit(own, _FEATURES, k=15, steps=100)
    return segment.profile(mixture.personas(own, _FEATURES, posterior).where("persona IS NOT NULL"), "persona", _FEATURES, ["gender", "region"])


@query()
def segment_learned_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prototypes of the regions from the best of 100 starts, with its loss."""
    columns = ["age", "risk", "family"]
    own = tables.kept(segment.standardised(frames.clients(spark, sf_dir), columns), "standardised")
    classes, found, loss = prototypes.learn(own, "region", columns, starts=100, steps=30)
    best = int(loss.argmin())
    rows = [(c, *map(float, w), float(loss[best])) for c, w in zip(classes, found[best], strict=True)]
    return spark.createDataFrame(rows, "region int, " + ", ".join(f"{c} double" for c in [*columns, "loss"]))


@query()
def reco_autoencoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE and count on held-out cells of a masked autoencoder of width 8."""
    _, scored, _ = client_queries._scored(spark, sf_dir)
    cells, held = [f"c{p}" for p in frames.ASSETS], [f"h{p}" for p in frames.ASSETS]
    long = scored.select("id", "product", "score", recommend.held_out("id", "product").cast("int").alias("out"))
    wide = long.groupBy("id").agg(
        *(F.max(F.when(F.col("product") == p, F.col("score"))).alias(f"c{p}") for p in frames.ASSETS),
        *(F.max(F.when(F.col("product") == p, F.col("out"))).alias(f"h{p}") for p in frames.ASSETS),
    )
    own = tables.kept(wide.na.fill(0, held), "interactions")
    layers, _ = autoencoder.train(own, "id", cells, held, steps=60)
    back = autoencoder.reconstructed(own, "id", cells, held, layers)
    parts = F.array(*(F.struct(F.lit(p).cast("long").alias("product"), F.col(f"c{p}").alias("fit")) for p in frames.ASSETS))
    fitted = back.select("id", F.explode(parts).alias("x")).select("id", "x.*")
    truth = long.where("out = 1")
    return truth.join(fitted, ["id", "product"]).agg(F.sqrt(F.avg(F.pow(F.col("score") - F.col("fit"), 2))).alias("rmse"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {frames.REPLICATION}, m AS (SELECT avg(r0) AS a, avg(r1) AS b, var_samp(r0) AS v, var_samp(r1) AS w, covar_samp(r0, r1) AS c FROM rep),
 d AS (SELECT date, (w * power(r0 - a, 2) - 2 * c * (r0 - a) * (r1 - b) + v * power(r1 - b, 2)) / (v * w - c * c) AS d2 FROM rep, m) SELECT date, round(d2, 6) AS d2 FROM d""")
def warning_mahalanobis_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared Mahalanobis distance in two dimensions, which a closed form can check."""
    own = warning.mahalanobis(frames.replication(spark, sf_dir), N[:2])
    return own.select("date", _R("d2").alias("d2"))


@query()
def warning_mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks by their distance from the mean of all instruments."""
    return warning.mahalanobis(frames.replication(spark, sf_dir), N).select("date", "d2")
