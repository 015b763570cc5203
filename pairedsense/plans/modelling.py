"""Vector, split, sampling and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import r6, r9
from ..operators import grid as gr
from ..operators import joins as jn
from ..operators import metrics as mt
from ..operators import models as ml
from ..operators import resample as rs
from ..operators import splits as sp
from ..operators import vectors as vc
from ..session import shared_path, stage
from . import bindings as b
from .oracle_ctes import with_ctes
from .registry import register


def vectors(spark, sf):
    return b.b_vectors(spark, sf).withColumnRenamed("embedding", "vector")


def swapped(spark, sf):
    """Representation that puts the second block before the first."""
    rep = spark.createDataFrame([("high", 0), ("low", 1)], "feature string, ordinal int")
    return vc.assemble(b.b_features(spark, sf), rep)


@register(
    "jn12_assemble",
    with_ctes("", "SELECT vec_id AS sample_id, CAST((p + 32) % 64 AS INTEGER) AS position, round(x, 9) + 0.0 AS x FROM e", "e AS (SELECT vec_id, unnest(range(0, 64)) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings)"),
)
def assemble(spark, sf):
    return swapped(spark, sf).select("sample_id", F.posexplode("vector").alias("position", "x")).select(
        "sample_id", "position", r9(F.col("x").cast("double")).alias("x")
    )


@register(
    "jn14_attach_features",
    with_ctes("vectors", "SELECT sample_id, label, round(embedding[33]::DOUBLE, 9) + 0.0 AS first FROM vectors WHERE device = 'R'"),
)
def attach(spark, sf):
    manifest = b.b_vectors(spark, sf).filter("device = 'R'").select("sample_id", "label")
    out = vc.attach_features(manifest, swapped(spark, sf))
    return out.select("sample_id", "label", r9(F.element_at("vector", 1).cast("double")).alias("first"))


@register(
    "jn10_attach_subject_features",
    with_ctes(
        "vectors",
        "SELECT sample_id, v.subject_id, round(coalesce(burden, 0), 6) + 0.0 AS burden FROM vectors v LEFT JOIN (SELECT user_id, avg(value) AS burden FROM events GROUP BY 1) ON user_id = v.subject_id",
    ),
)
def subject_features(spark, sf):
    means = b.table(spark, sf, "events").groupBy(F.col("user_id").alias("subject_id")).agg(F.avg("value").alias("burden"))
    rows = b.b_vectors(spark, sf).select("sample_id", "subject_id")
    feats = rows.select("subject_id").distinct().join(means, "subject_id", "left").withColumn("burden", F.coalesce("burden", F.lit(0.0)))
    return vc.attach_subject_features(rows, feats).select("sample_id", "subject_id", r6("burden").alias("burden"))


@register(
    "jn16_exclude_seen",
    """SELECT l_orderkey AS patient_id, l_linenumber, count(*) AS copies FROM lineitem WHERE l_linestatus = 'F' AND l_orderkey NOT IN
    (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O') GROUP BY ALL""",
)
def exclude_seen(spark, sf):
    lines = b.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "patient_id")
    out = jn.exclude_seen(lines.filter("l_linestatus = 'F'"), lines.filter("l_linestatus = 'O'"))
    return out.groupBy("patient_id", "l_linenumber").agg(F.count("*").alias("copies"))


def customers(spark, sf):
    """Order rows as clips: customer is the patient, priority parity the device."""
    o = b.table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("patient_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "recorder").otherwise("smartphone").alias("device"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )


CLIPS = """clips AS (SELECT o_orderkey AS row_id, o_custkey AS patient_id, CASE WHEN o_orderkey % 3 = 0 THEN 'recorder' ELSE 'smartphone' END AS device FROM orders)"""


def _grouped(where: str = "true") -> str:
    return f"""held AS (SELECT patient_id, row_number() OVER (ORDER BY md5('42|' || patient_id), patient_id) <= ceil(0.25::DOUBLE * count(*) OVER ()) AS test FROM
    (SELECT DISTINCT patient_id FROM clips WHERE {where}))"""


@register(
    "sp4_subject_holdout",
    with_ctes(
        "",
        """SELECT row_id, CASE WHEN v THEN 'validation' ELSE 'train' END AS role FROM clips JOIN (SELECT patient_id, row_number() OVER (ORDER BY md5('42|' || patient_id), patient_id)
        <= greatest(1, round_even(0.2::DOUBLE * count(*) OVER (), 0)) AS v FROM (SELECT DISTINCT patient_id FROM clips)) USING (patient_id)""",
        CLIPS,
    ),
)
def holdout(spark, sf):
    return sp.subject_holdout(customers(spark, sf), 0.2, b.SEED, "patient_id").select("row_id", "role")


@register("sp5_group_split", with_ctes("", "SELECT row_id, CASE WHEN test THEN 'test' ELSE 'train' END AS role FROM clips JOIN held USING (patient_id)", CLIPS + "," + _grouped()))
def group_split(spark, sf):
    return sp.group_split(customers(spark, sf), 0.25, b.SEED).select("row_id", "role")


@register(
    "sp6_build_experiment",
    with_ctes(
        "",
        """SELECT 'in_domain_recorder' AS experiment, row_id, CASE WHEN test THEN 'test' ELSE 'train' END AS role FROM clips JOIN held USING (patient_id) WHERE device = 'recorder'
        UNION ALL SELECT 'cross_recorder_to_smartphone', row_id, CASE WHEN device = 'recorder' THEN 'train' ELSE 'test' END FROM clips
        WHERE device = 'recorder' OR patient_id NOT IN (SELECT patient_id FROM clips WHERE device = 'recorder')
        UNION ALL SELECT 'combined_device_group_split', row_id, CASE WHEN test THEN 'test' ELSE 'train' END FROM clips JOIN
        (SELECT patient_id, row_number() OVER (ORDER BY md5('42|' || patient_id), patient_id) <= ceil(0.25::DOUBLE * count(*) OVER ()) AS test FROM (SELECT DISTINCT patient_id FROM clips)) USING (patient_id)""",
        CLIPS + "," + _grouped("device = 'recorder'"),
    ),
)
def experiments(spark, sf):
    rows = customers(spark, sf)
    parts = [
        sp.build_experiment(rows, name, 0.25, b.SEED, strict=True).select(F.lit(name).alias("experiment"), "row_id", "role")
        for name in ("in_domain_recorder", "cross_recorder_to_smartphone", "combined_device_group_split")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(
    "sp7_stratified_sample",
    with_ctes("vectors", "SELECT sample_id, device, label FROM (SELECT *, row_number() OVER (PARTITION BY device, label ORDER BY md5('42|' || sample_id), sample_id) AS rn FROM vectors) WHERE rn <= 40"),
)
def stratified(spark, sf):
    return sp.stratified(b.b_vectors(spark, sf), ["device", "label"], 40, "sample_id", b.SEED).select("sample_id", "device", "label")


@register(
    "ml1_fit_scaler",
    with_ctes(
        "vectors",
        """SELECT CAST(p AS INTEGER) AS position, round(avg(x), 9) + 0.0 AS mean, round(stddev_pop(x), 9) + 0.0 AS std FROM (SELECT unnest(range(0, 64)) AS p, unnest(embedding)::DOUBLE AS x
        FROM vectors WHERE fold <> 0) GROUP BY p""",
    ),
)
def scaler(spark, sf):
    fitted = vc.fit_scaler(vectors(spark, sf).filter("fold <> 0"))
    pairs = fitted.select(F.posexplode(F.arrays_zip("mean", "std")).alias("position", "p"))
    return pairs.select("position", r9("p.mean").alias("mean"), r9("p.std").alias("std"))


@register(
    "ml1_scale",
    with_ctes(
        "vectors",
        """SELECT sample_id, CAST(p AS INTEGER) AS position, round((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) + 0.0 AS z FROM (SELECT sample_id, unnest(range(0, 64)) AS p, unnest(embedding)::DOUBLE AS x FROM vectors)
        JOIN (SELECT p, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT unnest(range(0, 64)) AS p, unnest(embedding)::DOUBLE AS x FROM vectors WHERE fold <> 0) GROUP BY p) USING (p)""",
    ),
)
def scaled(spark, sf):
    v = vectors(spark, sf)
    out = vc.scale(v, vc.fit_scaler(v.filter("fold <> 0")))
    return out.select("sample_id", F.posexplode("vector").alias("position", "z")).select("sample_id", "position", r6("z").alias("z"))


@register(
    "ml6_class_weights",
    """SELECT label, n, round(t / (2.0::DOUBLE * n), 9) + 0.0 AS balanced_weight, round(greatest(1, (t - p) / CAST(p AS DOUBLE)), 9) + 0.0 AS positive_weight FROM (
    SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS label, count(*) AS n, sum(count(*)) OVER ()::DOUBLE AS t, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS p FROM orders GROUP BY 1)""",
)
def weights(spark, sf):
    o = b.table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("label"))
    out = sp.class_weights(o)
    return out.select("label", "n", r9("balanced_weight").alias("balanced_weight"), r9("positive_weight").alias("positive_weight"))


@register(
    "ml7_fit_plan",
    with_ctes(
        "results",
        """SELECT representation, classifier, protocol, fold, representation || '|' || classifier || '|' || fold || '|' || tr AS fit_key FROM
        (SELECT DISTINCT arm AS representation FROM results), (SELECT DISTINCT classifier FROM results), (SELECT DISTINCT fold FROM results),
        (VALUES ('R_R', 'R'), ('S_S', 'S'), ('R_S', 'R'), ('S_R', 'S'), ('RS_RS', 'RS')) AS p(protocol, tr)""",
    ),
)
def fit_plan(spark, sf):
    r = b.b_results(spark, sf)
    cells = jn.grid(
        r.select(F.col("arm").alias("representation")).distinct(),
        r.select("classifier").distinct(),
        r.select("fold").distinct(),
        sp.protocols(spark).select("protocol"),
    )
    return ml.fit_plan(cells).select("representation", "classifier", "protocol", "fold", "fit_key")


def stretched(spark, sf):
    """Vectors whose variance lies in known places: 1,000 times in the first 8 positions, plain in the next 8, nothing beyond."""
    scale = lambda x, i: F.when(i < 8, x.cast("double") * 1000.0).when(i < 16, x.cast("double")).otherwise(F.lit(0.0))
    return vectors(spark, sf).withColumn("vector", F.transform("vector", scale))


@register(
    "ml2_pca",
    with_ctes(
        "vectors",
        """SELECT d AS dimensions, role, outer_fold, sample_id, round(sum(pow(x - m, 2)) / 1e6, 3) + 0.0 AS energy FROM rows JOIN means USING (outer_fold, part, p) JOIN (SELECT unnest([8, 16]) AS d) ON p < d
        GROUP BY ALL""",
        """x AS (SELECT sample_id, fold, device, p, CASE WHEN p < 8 THEN x * 1000 ELSE x END AS x FROM (SELECT sample_id, fold, device, unnest(range(0, 16)) AS p, unnest(embedding[1:16])::DOUBLE AS x FROM vectors)),
        marked AS (SELECT x.*, k AS outer_fold, fold = k AS t, fold = (k + 1) % 5 AS v FROM x, (SELECT unnest(range(0, 5)) AS k)),
        means AS (SELECT outer_fold, 'tuning' AS part, p, avg(x) AS m FROM marked WHERE device = 'R' AND NOT t AND NOT v GROUP BY ALL
        UNION ALL SELECT outer_fold, 'refit', p, avg(x) FROM marked WHERE (device = 'R' AND NOT t) OR (device = 'S' AND v) GROUP BY ALL),
        rows AS (SELECT outer_fold, 'tuning_validation' AS role, 'tuning' AS part, sample_id, p, x FROM marked WHERE device = 'R' AND v
        UNION ALL SELECT outer_fold, 'test', 'refit', sample_id, p, x FROM marked WHERE device = 'S' AND t)""",
    ),
)
def pca(spark, sf):
    """16 axes and their first 8 on R_S of every fold: the variance is planted, so the axes must keep exactly what lies in the first 16 and 8 positions."""
    v = stage(stretched(spark, sf), "vectors")
    r, s = v.filter("device = 'R'"), v.filter("device = 'S'")
    energy = F.expr("aggregate(vector, 0D, (a, x) -> a + x * x)")
    out = None
    for fold in range(b.N_FOLDS):
        train, val, _ = ml.roles(r, fold, b.N_FOLDS)
        _, target, test = ml.roles(s, fold, b.N_FOLDS)
        for d, (_, tuned, _, tested) in vc.pca_fold(train, val, test, target, 16, [8, 16]).items():
            for role, rows in (("tuning_validation", tuned), ("test", tested)):
                part = rows.select(F.lit(d).alias("dimensions"), F.lit(role).alias("role"), F.lit(fold).cast("long").alias("outer_fold"), "sample_id", (F.round(energy / 1e6, 3) + 0.0).alias("energy"))
                out = part if out is None else out.unionByName(part)
    return out


@register(
    "ml3_coral",
    with_ctes(
        "vectors",
        """SELECT outer_fold, part, p AS position, (SELECT count(*) FROM source s WHERE s.outer_fold = t.outer_fold AND s.part = t.part) AS n, round(avg(x), 6) + 0.0 AS mean,
        round(var_samp(x), 3) + 0.0 AS variance, round(covar_samp(x, y), 3) + 0.0 AS covariance FROM target t GROUP BY ALL""",
        """marked AS (SELECT vectors.*, k AS outer_fold, fold = k AS t, fold = (k + 1) % 5 AS v FROM vectors, (SELECT unnest(range(0, 5)) AS k)),
        source AS (SELECT outer_fold, unnest(CASE WHEN v THEN ['refit'] ELSE ['tuning', 'refit'] END) AS part, sample_id FROM marked WHERE device = 'R' AND NOT t),
        target AS (SELECT outer_fold, unnest(['tuning', 'refit']) AS part, p, x, y FROM (SELECT outer_fold, CAST(unnest(range(0, 64)) AS INTEGER) AS p, unnest(embedding)::DOUBLE AS x,
        unnest(list_concat(embedding[2:64], embedding[1:1]))::DOUBLE AS y FROM marked WHERE device = 'S' AND v))""",
    ),
)
def coral(spark, sf):
    """Of every fold, for tuning and refit: all aligned source rows have the means, variances and covariances of the target's validation rows."""
    v = stage(vectors(spark, sf), "vectors")
    out = None
    for fold in range(b.N_FOLDS):
        train, validation, both, _ = gr.coral_plan(v, gr.Fit("", "", "", fold, ("R",), ("R_S",)), b.N_FOLDS)
        for part, rows in (("tuning", train), ("refit", both)):
            turned = rows.withColumn("vector", F.arrays_zip(F.col("vector").alias("x"), F.concat(F.slice("vector", 2, 63), F.slice("vector", 1, 1)).alias("y")))
            each = turned.select(F.posexplode("vector").alias("position", "_v")).select("position", "_v.*").toDF("position", "x", "y")
            part_rows = each.groupBy("position").agg(
                F.count("*").alias("n"), r6(F.avg("x")).alias("mean"), (F.round(F.var_samp("x"), 3) + 0.0).alias("variance"), (F.round(F.covar_samp("x", "y"), 3) + 0.0).alias("covariance")
            ).select(F.lit(fold).cast("long").alias("outer_fold"), F.lit(part).alias("part"), "position", "n", "mean", "variance", "covariance")
            out = part_rows if out is None else out.unionByName(part_rows)
    return out


PLANTED = 1.5  # twelve times the spread of a component: the classes can be told apart without error
APART = 8.0  # how far the phone's rows are moved along the same positions


def planted(spark, sf, moved: float = 0.0, everywhere: bool = False):
    """Vectors whose class stands in the first four positions, so that the right answer of a fit is known (in two of them as one value per class, which a tree splits at whatever its bins are); the phone's rows are moved there by ``moved``.

    A node of a forest is dealt 8 of 64 positions, and more than half of such draws hold none of four: a right fit of
    five trees need not tell all rows apart. ``everywhere`` has the class in all positions, in every second as one value.
    """
    sign = (F.col("label") * 2 - 1) * PLANTED + F.when(F.col("device") == "S", moved).otherwise(0.0)
    if everywhere:
        return vectors(spark, sf).withColumn("vector", F.transform("vector", lambda x, i: F.when(i % 2 == 0, sign).otherwise(x.cast("double") + sign)))
    return vectors(spark, sf).withColumn("vector", F.transform("vector", lambda x, i: F.when(i < 2, sign).when(i < 4, x.cast("double") + sign).otherwise(x.cast("double"))))


# Per classifier a candidate that learns nothing and one that learns.
CANDIDATES = {
    "logistic_regression": [{"maxIter": 0}, {"maxIter": 10}],
    "linear_svm": [{"maxIter": 0}, {"maxIter": 3}],
    "mlp": [{"maxIter": 0}, {"maxIter": 20}],
    "random_forest": [{"maxDepth": 0, "numTrees": 1}, {"maxDepth": 3, "numTrees": 5}],
    "gradient_boosted_trees": [{"maxDepth": 0, "maxIter": 1}, {"maxIter": 2}],
}
PROTOCOLS = [p for p, _, _ in sp.PROTOCOL_DEVICES]


def coverage(scored, by):
    """Rows, distinct samples, positives, valid probabilities, balanced accuracy and area under the curve of scored rows."""
    p = F.col("probability")
    counted = scored.groupBy(*by).agg(
        F.countDistinct("sample_id").alias("samples"), F.sum(F.col("label").cast("long")).alias("positives"), F.count_if((p >= 0) & (p <= 1)).alias("valid")
    )
    quality = gr.cell_metrics(scored, by).select(*by, "n", r6("balanced_accuracy").alias("balanced_accuracy"), r6("roc_auc").alias("roc_auc"))
    return quality.join(counted, list(by))


COVERAGE = "count(*) AS n, count(DISTINCT sample_id) AS samples, CAST(sum(label) AS BIGINT) AS positives, count(*) AS valid"
PERFECT = "1.0::DOUBLE AS balanced_accuracy, 1.0::DOUBLE AS roc_auc"


@register(
    "ml3_coral_fold",
    with_ctes(
        "vectors",
        f"""SELECT plan, protocol, fold, {COVERAGE}, CASE plan WHEN 'target_raw' THEN 1.0 ELSE 0.5 END::DOUBLE AS balanced_accuracy, 1.0::DOUBLE AS roc_auc FROM vectors
        JOIN (SELECT unnest(['R_S', 'S_R']) AS protocol) ON split_part(protocol, '_', 2) = device, (SELECT unnest(['plain', 'coral', 'target_raw']) AS plan) GROUP BY ALL""",
    ),
)
def coral_fold(spark, sf):
    """Both cross-device protocols, all folds: the phone's rows are moved far along the positions that tell the classes apart.

    Without alignment all test rows fall on one side (0.5); with aligned source rows the raw test rows are told apart
    (1.0); test rows that also pass through the alignment are moved once more (0.5).
    """
    v = stage(planted(spark, sf, APART).withColumn("vector", F.slice("vector", 1, 16)), "vectors")
    plans = {"plain": gr.plain_plan, "coral": gr.coral_plan, "target_raw": gr.coral_raw_plan}
    out = None
    for name, plan in plans.items():
        p = gr.run_grid({"first": v}, {"logistic_regression": [{"maxIter": 10}]}, ["R_S", "S_R"], range(b.N_FOLDS), b.N_FOLDS, workers=8, seed=b.SEED, split=plan)
        rows = coverage(p, ["protocol", "fold"]).withColumn("plan", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("ml4_select_and_fit", with_ctes("vectors", f"SELECT fold, device, 1 AS selected, {COVERAGE}, {PERFECT} FROM vectors GROUP BY ALL"))
def select_and_fit(spark, sf):
    """Every fold: two candidates judged on validation, the better one refitted, the test rows scored."""
    v = stage(planted(spark, sf), "vectors")
    out = None
    for fold in range(b.N_FOLDS):
        role = ml.roles(v, fold, b.N_FOLDS)
        model, chosen, _ = ml.select_and_fit(role[0], role[1], "logistic_regression", CANDIDATES["logistic_regression"], b.SEED)
        scored = ml.score(model, role[2]).withColumn("selected", F.lit(CANDIDATES["logistic_regression"].index(chosen)))
        out = scored if out is None else out.unionByName(scored)
    return coverage(stage(out, "scored"), ["fold", "device", "selected"])


@register(
    "ml5_classifiers",
    with_ctes(
        "vectors",
        f"SELECT c AS classifier, fold, {COVERAGE}, {PERFECT} FROM vectors CROSS JOIN (SELECT unnest(['random_forest', 'gradient_boosted_trees', 'logistic_regression', 'linear_svm', 'mlp']) AS c) GROUP BY c, fold",
    ),
)
def classifiers(spark, sf):
    """Every classifier on every fold, trained on both devices."""
    out = None
    for forest in (False, True):
        v = stage(planted(spark, sf, everywhere=forest), "vectors")
        learning = {name: both[1:] for name, both in CANDIDATES.items() if (name == "random_forest") == forest}
        p = gr.run_grid({"full": v}, learning, ["RS_RS"], range(b.N_FOLDS), b.N_FOLDS, workers=8, seed=b.SEED)
        out = p if out is None else out.unionByName(p)
    return coverage(stage(out, "predictions"), ["classifier", "fold"])


def _grid(name: str, *classifiers: str):
    names = ", ".join(f"'{c}'" for c in classifiers)
    sql = f"""SELECT representation, classifier, protocol, fold, 1 AS selected, {COVERAGE}, {PERFECT} FROM vectors
        JOIN (SELECT unnest({PROTOCOLS}) AS protocol) ON contains(split_part(protocol, '_', 2), device), (SELECT unnest(['full', 'low']) AS representation), (SELECT unnest([{names}]) AS classifier) GROUP BY ALL"""

    def run(spark, sf):
        v = stage(planted(spark, sf, everywhere="random_forest" in classifiers), "vectors")
        low = v.withColumn("vector", F.slice("vector", 1, 32))
        root = shared_path(spark, "grid")
        asked = {c: CANDIDATES[c] for c in classifiers}
        p = gr.run_grid({"full": v, "low": low}, asked, PROTOCOLS, range(b.N_FOLDS), b.N_FOLDS, root, workers=8, seed=b.SEED)
        chosen = gr.records(spark, root).select(*gr.CELL, "selected")
        return coverage(stage(p, "predictions"), list(gr.CELL)).join(chosen, list(gr.CELL))

    run.__doc__ = f"Two representations, {', '.join(classifiers)} with two candidates, all protocols and folds."
    register(name, with_ctes("vectors", sql))(run)


_grid("ml8_run_grid", "logistic_regression")
_grid("ml8_run_grid_svm", "linear_svm")
_grid("ml8_run_grid_perceptron", "mlp")
_grid("ml8_run_grid_forest", "random_forest")
_grid("ml8_run_grid_boosted", "gradient_boosted_trees")


@register(
    "ml9_device_probe",
    with_ctes(
        "vectors",
        """SELECT fold, count(*) AS n, count(DISTINCT sample_id) AS samples, count(*) FILTER (device = 'S') AS positives, count(*) AS valid, 1.0::DOUBLE AS balanced_accuracy, 1.0::DOUBLE AS roc_auc,
        CAST(2000 AS BIGINT) AS draws, 1.0::DOUBLE AS low, 1.0::DOUBLE AS high FROM vectors GROUP BY fold""",
    ),
)
def device_probe(spark, sf):
    """The probe of every fold on rows that give their device away, with the bootstrap limits of the subjects' accuracies."""
    v = stage(planted(spark, sf, APART), "vectors")
    scored = None
    for fold in range(b.N_FOLDS):
        rows = ml.device_probe(v, fold)
        scored = rows if scored is None else scored.unionByName(rows)
    scored = stage(scored, "probe")
    per = mt.binary_metrics(scored, ["fold", "subject_id"]).select("fold", "subject_id", "accuracy")
    drawn = rs.draws(per, ["fold"], "subject_id", ["accuracy"], 2000, b.SEED)
    limits = rs.interval(rs.long_draws(drawn, ["fold"], ["accuracy"]), ["fold"])
    ci = limits.select("fold", F.col("iterations").alias("draws"), r6("ci95_low").alias("low"), r6("ci95_high").alias("high"))
    return coverage(scored, ["fold"]).join(ci, "fold")


@register(
    "ml10_silhouette",
    with_ctes(
        "vectors",
        """SELECT 'device' AS grouping, count(*) AS n, round(avg((b - a) / greatest(a, b)), 9) + 0.0 AS silhouette FROM (
        SELECT x.sample_id, sum(list_distance(x.v, y.v)) FILTER (y.device = x.device) / (count(*) FILTER (y.device = x.device) - 1) AS a,
        avg(list_distance(x.v, y.v)) FILTER (y.device <> x.device) AS b FROM s x CROSS JOIN s y GROUP BY x.sample_id)""",
        """s AS (SELECT sample_id, device, embedding::DOUBLE[] AS v FROM (SELECT *, row_number() OVER (PARTITION BY device, label ORDER BY md5('42|' || sample_id), sample_id) AS rn FROM vectors) WHERE rn <= 600)""",
    ),
)
def silhouette(spark, sf):
    sample = sp.stratified(vectors(spark, sf), ["device", "label"], 600, "sample_id", b.SEED)
    return vc.silhouette(sample, "device").select("grouping", "n", r9("silhouette").alias("silhouette"))


_RAW = """SELECT '{0}' AS grouping, count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) + 0.0 AS silhouette FROM (
        SELECT x.sample_id, sum(list_distance(x.v, y.v)) FILTER (y.{0} = x.{0}) / (count(*) FILTER (y.{0} = x.{0}) - 1) AS a,
        avg(list_distance(x.v, y.v)) FILTER (y.{0} <> x.{0}) AS b FROM s x CROSS JOIN s y GROUP BY x.sample_id)"""


@register(
    "ml10_separation",
    with_ctes(
        "vectors",
        f"SELECT *, 1.0::DOUBLE AS explained FROM ({_RAW.format('device')} UNION ALL {_RAW.format('label')})",
        """s AS (SELECT sample_id, device, label, embedding[1:10]::DOUBLE[] AS v FROM (SELECT *, row_number() OVER (PARTITION BY device, label ORDER BY md5('42|' || sample_id), sample_id) AS rn FROM vectors) WHERE rn <= 600)""",
    ),
)
def separation(spark, sf):
    """10 of 64 axes of vectors that have no variance beyond ten positions: the silhouettes are those of these positions."""
    ten = vectors(spark, sf).withColumn("vector", F.transform("vector", lambda x, i: F.when(i < 10, x).otherwise(F.lit(0.0).cast("float"))))
    return vc.separation(ten, 600, 10, b.SEED).select("grouping", "n", r6("silhouette").alias("silhouette"), r6("explained_variance").alias("explained"))


def halves(spark, sf):
    return b.table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("r"), F.slice("embedding", 33, 32).alias("s"))


@register(
    "ml11_pair_contrast",
    with_ctes(
        "",
        """SELECT batch, count(*) // 2 AS pairs, round(avg(lse - pos), 6) + 0.0 AS loss FROM (SELECT x.batch, x.vec_id, x.side,
        ln(sum(exp(list_cosine_similarity(x.v, y.v) / 0.1::DOUBLE)) FILTER (y.vec_id <> x.vec_id OR y.side <> x.side)) AS lse,
        max(list_cosine_similarity(x.v, y.v) / 0.1::DOUBLE) FILTER (y.vec_id = x.vec_id AND y.side <> x.side) AS pos FROM z x JOIN z y ON y.batch = x.batch GROUP BY ALL) GROUP BY batch""",
        """dealt AS (SELECT vec_id, embedding, (row_number() OVER (ORDER BY md5('42|' || vec_id), vec_id) - 1) // 64 AS batch FROM embeddings),
        z AS (SELECT batch, vec_id, 'r' AS side, embedding[1:32]::DOUBLE[] AS v FROM dealt UNION ALL SELECT batch, vec_id, 's', embedding[33:64]::DOUBLE[] FROM dealt)""",
    ),
)
def contrast(spark, sf):
    out = vc.pair_contrast(halves(spark, sf), "vec_id", 0.1, 64, b.SEED)
    return out.select("batch", "pairs", r6("loss").alias("loss"))


@register(
    "ml11_cross_covariance",
    with_ctes(
        "",
        """SELECT count(*) AS pairs, round(avg(c * c), 9) + 0.0 AS penalty FROM (SELECT i, j, covar_samp(x, y) / ((stddev_samp(x) + 1e-6) * (stddev_samp(y) + 1e-6)) AS c FROM
        (SELECT vec_id, unnest(range(0, 32)) AS i, unnest(embedding[1:32])::DOUBLE AS x FROM embeddings) JOIN
        (SELECT vec_id, unnest(range(0, 32)) AS j, unnest(embedding[33:64])::DOUBLE AS y FROM embeddings) USING (vec_id) GROUP BY i, j)""",
    ),
)
def cross_covariance(spark, sf):
    out = vc.cross_covariance(halves(spark, sf), "r", "s")
    return out.select("pairs", r9("penalty").alias("penalty"))
