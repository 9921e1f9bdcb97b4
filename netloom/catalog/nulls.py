"""I: splits, sampling, null models."""

import re

from pyspark.sql import Window as W, functions as F

from netloom.catalog import query
from netloom.catalog.aggregates import ULM, rr
from netloom.operators import nulls as Z
from netloom.plans import metrics as M

POBS = "po AS (SELECT obs_id, row_no, concat(donor_id, '_', cell_type) AS perturbation, donor_id = 'D0' AS is_control, donor_id, cell_type, plate FROM v_obs)"
PTF = "ptf AS (SELECT DISTINCT concat(donor_id, '_', cell_type) AS tf FROM v_obs WHERE cell_type IN ('BUILDING', 'MACHINERY'))"


def pobs(v):
    return v.obs.withColumn("perturbation", F.concat_ws("_", "donor_id", "cell_type")).withColumn("is_control", F.col("donor_id") == "D0")


SPLIT = """SELECT split, perturbation FROM (SELECT perturbation, CASE WHEN row_number() OVER (PARTITION BY is_tf ORDER BY $HASH(perturbation, '32'), perturbation) <= floor(count(*) OVER (PARTITION BY is_tf) * 0.5) THEN 'train' ELSE 'test' END AS split
FROM (SELECT DISTINCT perturbation, {tf} AS is_tf FROM po WHERE NOT is_control) x) y
UNION ALL SELECT unnest(['train', 'test']), perturbation FROM (SELECT DISTINCT perturbation FROM po WHERE is_control) z"""


@query("i1_split_stratified", f"WITH {POBS}, {PTF} " + SPLIT.format(tf="perturbation IN (SELECT tf FROM ptf)"))
def _(v):
    tfs = pobs(v).where("cell_type in ('BUILDING', 'MACHINERY')").select(F.col("perturbation").alias("tf")).distinct()
    return Z.split_perturbations(pobs(v), 0.5, tfs)


@query("i2_split_plain", f"WITH {POBS} " + SPLIT.format(tf="false"))
def _(v):
    return Z.split_perturbations(pobs(v), 0.5)


@query("i3_rule_split", "SELECT obs_id, CASE WHEN (donor_id, plate) IN (SELECT DISTINCT donor_id, plate FROM v_obs WHERE (donor_id = 'D1' AND plate = '1995') OR donor_id = 'D4') THEN 'train' ELSE 'test' END AS split FROM v_obs")
def _(v):
    rules = v.obs.where("(donor_id = 'D1' and plate = '1995') or donor_id = 'D4'").select("donor_id", "plate")
    return Z.rule_split(v.obs, rules, ["donor_id", "plate"]).select("obs_id", "split")


@query("i4_group_shuffle", f"""WITH {POBS}, g AS (SELECT perturbation, row_number() OVER (ORDER BY $HASH(perturbation, '42'), perturbation) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT perturbation FROM po) x)
SELECT obs_id, i >= ceil(n * 0.5) AS is_train FROM po JOIN g USING (perturbation)""")
def _(v):
    return Z.group_shuffle(pobs(v), "perturbation").select("obs_id", "is_train")


@query("i5_group_kfold", f"""WITH {POBS}, g AS (SELECT perturbation, count(*) AS n FROM po GROUP BY 1), d AS (SELECT *, row_number() OVER (ORDER BY n DESC, perturbation) - 1 AS i FROM g),
f AS (SELECT CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END AS fold, n FROM d)
SELECT count(*) AS n_groups, count(DISTINCT perturbation) AS n_names, (SELECT max(n) FROM g) >= (SELECT max(s) - min(s) FROM (SELECT sum(n) AS s FROM f GROUP BY fold) x) AS balanced FROM g""")
def _(v):
    o = pobs(v)
    at = Z.group_kfold(o, "perturbation")
    load = o.join(at, "perturbation").groupBy("fold").agg(F.count("*").alias("n")).agg((F.max("n") - F.min("n")).alias("spread"))
    most = o.groupBy("perturbation").agg(F.count("*").alias("n")).agg(F.max("n")).scalar()
    return at.agg(F.count("*").alias("n_groups"), F.count_distinct("perturbation").alias("n_names")).withColumn("balanced", load.select("spread").scalar() <= most)


@query("i5_fold_table", f"""WITH {POBS}, g AS (SELECT perturbation, count(*) AS n FROM po GROUP BY 1), d AS (SELECT *, row_number() OVER (ORDER BY n DESC, perturbation) - 1 AS i FROM g)
SELECT n, count(*) AS n_groups, min((i // 5)) AS first_round, max(i // 5) AS last_round FROM d GROUP BY n""")
def _(v):
    o = pobs(v)
    size = o.groupBy("perturbation").agg(F.count("*").alias("n"))
    at = Z.group_kfold(o, "perturbation").join(size, "perturbation")
    first = F.coalesce(F.sum("n_groups").over(W.orderBy(F.col("n").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = at.groupBy("n").agg(F.count("*").alias("n_groups")).withColumn("_b", first)
    return per.select("n", "n_groups", F.floor(F.col("_b") / 5).alias("first_round"), F.floor((F.col("_b") + F.col("n_groups") - 1) / 5).alias("last_round"))


@query("i6_folds", """SELECT 'random' AS kind, obs_id, CAST(CAST(concat('0x', substr($HASH(obs_id, '51966'), 1, 8)) AS BIGINT) % 5 AS VARCHAR) AS fold FROM v_obs
UNION ALL SELECT 'group', obs_id, donor_id FROM v_obs WHERE donor_id IN (SELECT donor_id FROM v_obs GROUP BY 1 HAVING count(*) >= 600)""")
def _(v):
    a = Z.folds(v.obs).withColumn("kind", F.lit("random"))
    return a.unionByName(Z.folds(v.obs, "donor_id", min_rows=600).withColumn("kind", F.lit("group")))


I7 = """WITH g AS (SELECT target, row_number() OVER (ORDER BY $HASH(target, '0g'), target) - 1 AS i FROM (SELECT DISTINCT target FROM v_edges) x), n AS (SELECT count(*) AS n FROM g),
d AS (SELECT source, unnest(range(1, CAST(ceil(n * 0.02 + 12 * sqrt(n * 0.02) + 12) AS BIGINT) + 1)) AS j FROM (SELECT DISTINCT tf AS source FROM v_tfs) t, n),
w AS (SELECT source, j, sum(1 + CAST(floor(ln(greatest($U(source, j, '0a'), 1e-12)) / ln(0.98)) AS BIGINT)) OVER (PARTITION BY source ORDER BY j) - 1 AS i FROM d)
SELECT source, target, CASE WHEN $U(source, j, '0b') < 0.5 THEN -1.0 ELSE 1.0 END::DOUBLE AS weight FROM w JOIN g USING (i)"""


@query("i7_negative_control", I7)
def _(v):
    return Z.negative_control(v.edges.select(F.col("target").alias("gene")).distinct(), v.tfs)


@query("i8_positive_control", """WITH b AS (SELECT o.obs_id, g.gene, coalesce(n.value, 0) AS v FROM v_bobs o CROSS JOIN (SELECT DISTINCT gene FROM v_bulk) g LEFT JOIN v_bulk n ON n.obs_id = o.obs_id AND n.gene = g.gene)
SELECT x.gene AS source, y.gene AS target, r(corr(x.v, y.v)) AS weight FROM b x JOIN b y ON x.obs_id = y.obs_id AND x.gene < y.gene WHERE x.gene IN (SELECT tf FROM v_gtfs) GROUP BY 1, 2""")
def _(v):
    return rr(M.correlation_network(v.bulk, v.bobs, v.gtfs), "weight")


RND = """k AS (SELECT model, source, count(*) AS k FROM v_net GROUP BY 1, 2), rk AS (SELECT model, source, weight, row_number() OVER (PARTITION BY model, source ORDER BY abs(weight) DESC, source, target) AS rn FROM v_net),
g AS (SELECT gene, row_number() OVER (ORDER BY $HASH(gene, '42g'), gene) - 1 AS i FROM (SELECT DISTINCT gene FROM v_counts) x), gn AS (SELECT count(*) AS n FROM g),
pr AS (SELECT n, x AS p FROM gn, range(2, 20000) t(x) WHERE x >= n AND NOT EXISTS (SELECT 1 FROM range(2, 200) d(y) WHERE y * y <= x AND x % y = 0) ORDER BY x LIMIT 1),
dj AS (SELECT model, source, j, CAST(floor($U(source, '42a') * p) + j * (1 + floor($U(source, '42s') * (p - 1))) AS BIGINT) % p AS i FROM (SELECT model, source, k, unnest(range(0, least(k + 1 + p - n, p))) AS j, p FROM k, pr) x),
dr AS (SELECT model, source, gene AS target, row_number() OVER (PARTITION BY model, source ORDER BY j) AS rn FROM dj JOIN g USING (i) WHERE source <> gene),
nul AS (SELECT model, dr.source, dr.target, rk.weight FROM dr JOIN rk USING (model, source, rn))"""


@query("i9_random_sets", f"WITH {RND} SELECT model, source, target, r(weight) AS weight FROM nul")
def _(v):
    return rr(Z.random_partners(v.net, v.counts.select("gene").distinct(), extra=["model"]), "weight")


@query("i10_shuffled_regulators", f"WITH {RND} SELECT model, target AS source, source AS target, r(weight) AS weight FROM nul")
def _(v):
    # the same draw with the roles of the ends exchanged
    e = v.net.select("model", F.col("target").alias("source"), F.col("source").alias("target"), "weight")
    return rr(Z.random_partners(e, v.counts.select("gene").distinct(), by="target", extra=["model"]), "weight")


I11 = """WITH e AS (SELECT model, source, target, weight FROM v_net WHERE source <> target AND weight <> 0),
l AS (SELECT model, source, row_number() OVER (PARTITION BY model ORDER BY $HASH(source, target, '7a'), source, target) AS i FROM e), r AS (SELECT model, target, row_number() OVER (PARTITION BY model ORDER BY $HASH(source, target, '7b'), source, target) AS i FROM e),
p AS (SELECT DISTINCT model, source, target FROM l JOIN r USING (model, i) WHERE source <> target), d AS (SELECT model, target, count(*) AS d, sum(abs(weight)) AS s FROM e GROUP BY 1, 2),
n AS (SELECT model, source, target, row_number() OVER (PARTITION BY model, source ORDER BY d DESC, round(s, 6) DESC, target) AS rn FROM p JOIN d USING (model, target)),
o AS (SELECT model, source, weight, row_number() OVER (PARTITION BY model, source ORDER BY abs(weight) DESC, weight, target) AS rn FROM e)
SELECT model, n.source, n.target, r(o.weight) AS weight FROM n JOIN o USING (model, source, rn)"""


@query("i11_degree_null", I11)
def _(v):
    return rr(Z.degree_null(v.net, extra=["model"]), "weight")


def noise_sql(degree):
    """The four kinds at one degree as a union of (noise, model, source, target, weight); common tables first."""
    ctes = f"""e AS (SELECT model, source, target, weight FROM v_net), n AS (SELECT model, count(*) AS n, stddev_samp(weight) AS sd, count(DISTINCT source) AS rs, count(DISTINCT target) AS cs FROM e GROUP BY 1),
d AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY $HASH(source, target, '0direction'), source, target) - 1 AS i FROM e), f AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY $HASH(source, target, '0sign'), source, target) - 1 AS i FROM e),
si AS (SELECT model, source, row_number() OVER (PARTITION BY model ORDER BY $HASH(source, '0source'), source) - 1 AS s FROM (SELECT DISTINCT model, source FROM e) x),
ti AS (SELECT model, target, row_number() OVER (PARTITION BY model ORDER BY $HASH(target, '0target'), target) - 1 AS t FROM (SELECT DISTINCT model, target FROM e) x),
p AS (SELECT model, source, target, weight, s, t, rs, cs FROM e JOIN n USING (model) JOIN si USING (model, source) JOIN ti USING (model, target) WHERE weight <> 0),
q AS (SELECT *, s * cs + t AS pos FROM MIXED),
mv AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY $HASH(source, target, '0v'), source, target) - 1 AS i FROM q WHERE pos < floor(rs * cs * {degree})),
bk AS (SELECT model, weight, s, t FROM BACK)"""
    forward, back = "p", "(SELECT * REPLACE (i // cs AS s, i % cs AS t) FROM mv)"
    for r in range(4):
        col, by, m = ("t", "s", "cs") if r % 2 == 0 else ("s", "t", "rs")
        forward = f"(SELECT * REPLACE (({col} + CAST(floor($U({by}, '0n{r}') * {m}) AS BIGINT)) % {m} AS {col}) FROM {forward} z{r})"
    for r in reversed(range(4)):
        col, by, m = ("t", "s", "cs") if r % 2 == 0 else ("s", "t", "rs")
        back = f"(SELECT * REPLACE (({col} - CAST(floor($U({by}, '0n{r}') * {m}) AS BIGINT) + {m}) % {m} AS {col}) FROM {back} y{r})"
    ctes = ctes.replace("MIXED", forward + " x").replace("BACK", back + " x")
    net = "SELECT 'net' AS noise, model, source, target, weight FROM e" if not degree else """SELECT 'net' AS noise, model, source, target, weight FROM bk JOIN si USING (model, s) JOIN ti USING (model, t)
UNION ALL SELECT 'net', model, source, target, weight FROM q WHERE pos >= floor(rs * cs * DEGREE)""".replace("DEGREE", str(degree))
    return ctes, f"""SELECT 'direction' AS noise, model, CASE WHEN i < floor(n * {degree}) THEN target ELSE source END AS source, CASE WHEN i < floor(n * {degree}) THEN source ELSE target END AS target, weight FROM d JOIN n USING (model)
UNION ALL SELECT 'sign', model, source, target, CASE WHEN i < floor(n * {degree}) THEN -weight ELSE weight END FROM f JOIN n USING (model)
UNION ALL SELECT 'weight', model, source, target, weight + sqrt(-2 * ln(greatest($U(source, target, '0wa'), 1e-12))) * cos(2 * pi() * $U(source, target, '0wb')) * {degree} * sd FROM e JOIN n USING (model)
UNION ALL {net}"""


CTES, UNION = noise_sql(0.5)


@query("i12_edge_noise", f"WITH {CTES} SELECT noise, model, source, target, r(weight) AS weight FROM ({UNION}) u")
def _(v):
    return rr(Z.noise_sweep(v.net, [0.5], keys=["model"]).drop("level"), "weight")


def sweep_sql(degrees=(0.0, 0.2, 0.5, 1.0)):
    """All kinds at all degrees as networks of their own, then replicate consistency of each as in K7."""
    ctes, parts = [], []
    for i, degree in enumerate(degrees):
        c, u = noise_sql(degree)
        keep, moved = c.split(",\nmv AS ", 1)
        moved, u = (re.sub(r"\b(mv|bk)\b", rf"\g<1>{i}", x) for x in (f"mv AS {moved}", u))
        ctes += [keep, moved] if not i else [moved]
        parts.append(f"SELECT concat(noise, '~{degree}~', model) AS k, source, target, weight FROM ({u}) u{i}")
    net = "net AS (SELECT concat(k, '|', source) AS source, target, weight FROM (" + " UNION ALL ".join(parts) + ") w)"
    return f"""WITH {', '.join(ctes)}, {net}, {ULM}, {CONSISTENT}, y AS (SELECT model, sum(s) / 10 AS value FROM rc GROUP BY model),
z AS (SELECT split_part(model, '~', 1) AS noise, CAST(split_part(model, '~', 2) AS DOUBLE) AS level, split_part(model, '~', 3) AS model, value FROM y)
SELECT noise, level, model, r(value) AS value, r(max(value) FILTER (level = 0) OVER (PARTITION BY noise, model) - value) AS "drop" FROM z"""


CONSISTENT = """am AS (SELECT u.source, o.cell_type AS grp, u.activity, median(u.activity) OVER (PARTITION BY u.source, o.cell_type) AS med FROM ulm u JOIN v_bobs o USING (obs_id)),
md AS (SELECT source, avg(mad) AS mad FROM (SELECT source, grp, avg(abs(activity - med)) AS mad FROM am GROUP BY ALL HAVING count(*) >= 2) x GROUP BY 1),
ce AS (SELECT source, split_part(source, '|', 1) AS model, row_number() OVER (PARTITION BY split_part(source, '|', 1) ORDER BY count(*) DESC, source) AS rank FROM net GROUP BY source), sz AS (SELECT unnest([10, 42, 74, 106, 138, 171, 203, 235, 267, 300]) AS size),
dm AS (SELECT model, size, mad FROM md JOIN ce USING (source) JOIN sz ON size >= rank), dq AS (SELECT model, size, quantile_cont(mad, 0.95) AS p95 FROM dm GROUP BY 1, 2),
rc AS (SELECT model, size, sum(1 - greatest(0, least(1, mad / p95))) / size AS s FROM dm JOIN dq USING (model, size) GROUP BY model, size)"""


@query("i13_noise_sweep", sweep_sql())
def _(v):
    return rr(M.robustness(v.net, v.bulk, v.bobs.withColumn("grp", F.col("cell_type")), keys=["model"]), "value", "drop")


@query("i14_shrink", """WITH o AS (SELECT obs_id FROM v_obs WHERE donor_id = 'D3' ORDER BY row_no LIMIT 300), e AS (SELECT c.* FROM v_counts c WHERE obs_id IN (SELECT obs_id FROM o) AND gene LIKE '%/PROMO')
SELECT obs_id, gene, value FROM e WHERE gene IN (SELECT gene FROM e GROUP BY 1 ORDER BY round(sum(value), 6) DESC, gene LIMIT 15)""")
def _(v):
    loc = v.counts.select("gene").distinct().withColumn("chrom", F.when(F.col("gene").endswith("/PROMO"), "chr1").otherwise("chr2"))
    return Z.shrink(v.counts, v.obs, loc, "D3", "chr1", 300, 15).select("obs_id", "gene", "value")
