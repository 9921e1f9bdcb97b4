"""Projections, filters and predicates on expression, metadata, peak and edge tables.

Lookup sides (gene lists, rule tables) are joined without a hint: the optimiser broadcasts one
only when its measured size is under the session threshold, and shuffles it otherwise.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from netloom.functions.text import canonical, interval_parts
from netloom.operators.blocks import attach_all

DEFAULT_LAYERS = ("lognorm", "X_norm")
NORM_ONLY = ("adamson", "norman", "nakatake")  # fixed values: datasets that ship X_norm only


def pick_layer(expr: DataFrame, layer=None, dataset=None) -> DataFrame:
    """Keep one layer: the wanted one, else the first default present."""
    asked = [layer] if layer else list(DEFAULT_LAYERS)
    flags = expr.agg(*[F.bool_or(F.col("layer") == x) for x in [*asked, "X_norm"]]).first()  # one row, however many layers
    want = next((x for x, here in zip(asked, flags) if here), None)
    if want is None and layer and flags[-1] and dataset in NORM_ONLY:
        want = "X_norm"
    if want is None:
        raise ValueError(f"layer {layer or ' or '.join(DEFAULT_LAYERS)} not found")
    return expr.where(F.col("layer") == want)


def tf_filter(edges, tfs):
    """Edges whose source is a transcription factor."""
    return edges.join(tfs.select(F.col("tf").alias("source")), "source", "left_semi")


def drop_self(edges):
    return edges.where(F.col("source") != F.col("target"))


def to_weight(c="weight"):
    """Text weight to double; anything that is not a number becomes null."""
    return F.nullif(F.col(c).try_cast("double"), F.lit(float("nan")))


def sign(c="weight"):
    return F.signum(F.col(c)).cast("int")


def mito_flag(c="gene"):
    return F.col(c).startswith("MT-")


def basic_qc(expr, min_genes=200, max_genes=5000, min_cells=10):
    """Cells with a gene count in range and genes seen in more than ``min_cells`` cells.
    Both masks are taken from the unfiltered table."""
    cells = (expr.groupBy("obs_id").agg(F.count_if(F.col("value") > 0).alias("n"))
             .where(F.col("n").between(min_genes, max_genes)).select("obs_id"))
    genes = (expr.groupBy("gene").agg(F.count_if(F.col("value") != 0).alias("n"))
             .where(F.col("n") > min_cells).select("gene"))
    return expr.join(genes, "gene", "left_semi").join(cells, "obs_id", "left_semi")


def qc_perturbation(expr, obs, min_cells_per_pert=10, min_cells_per_gene=10, min_genes_per_cell=200):
    """Three filters in order: small perturbations, rare genes, poor cells."""
    keep = (obs.groupBy("perturbation").agg(F.count("*").alias("n"))
            .where(F.col("n") >= min_cells_per_pert).select("perturbation"))
    obs = obs.join(keep, "perturbation", "left_semi")
    e = expr.join(obs.select("obs_id"), "obs_id", "left_semi")
    genes = (e.groupBy("gene").agg(F.count_if(F.col("value") > 0).alias("n"))
             .where(F.col("n") >= min_cells_per_gene).select("gene"))
    e = e.join(genes, "gene", "left_semi")
    cells = (e.groupBy("obs_id").agg(F.count_if(F.col("value") > 0).alias("n"))
             .where(F.col("n") >= min_genes_per_cell).select("obs_id"))
    return e.join(cells, "obs_id", "left_semi")


def qc_ranges(obs, bounds):
    """Rows whose metadata lie in closed ranges; ``None`` leaves a side open."""
    cond = F.lit(True)
    for c, (lo, hi) in bounds.items():
        if lo is not None:
            cond = cond & (F.col(c) >= lo)
        if hi is not None:
            cond = cond & (F.col(c) <= hi)
    return obs.where(cond)


def genes_max_plate(expr, obs, n=100):
    """Genes expressed in at least ``n`` cells of some plate."""
    per = (expr.where(F.col("value") > 0).join(obs.select("obs_id", "plate"), "obs_id")
           .groupBy("gene", "plate").agg(F.count("*").alias("n_cells")))
    return per.groupBy("gene").agg(F.max("n_cells").alias("max_cells")).where(F.col("max_cells") >= n)


def coverage_filter(expr, obs, max_zero=0.7):
    """Genes with a share of zeros of at most ``max_zero``; absent rows count as zeros."""
    n = obs.select(F.count("*")).scalar()
    return (expr.groupBy("gene").agg(F.count_if(F.col("value") != 0).alias("nnz"))
            .withColumn("zero_share", 1 - F.col("nnz") / n).where(F.col("zero_share") <= max_zero))


def filter_samples(obs, drop_names, min_cells, pair_rules, name="perturbation", min_types=3):
    """Sample rules: named outliers, few cells, names with too few rows in some donor, and
    (name, donor) exclusions."""
    out = obs.join(drop_names.select(name), name, "left_anti").where(F.col("cell_count") >= min_cells)
    thin = (out.groupBy("donor_id", name).agg(F.count("*").alias("n"))
            .where(F.col("n") < min_types).select(name).distinct())
    return out.join(thin, name, "left_anti").join(pair_rules.select(name, "donor_id"), [name, "donor_id"], "left_anti")


def match_terms(df, col, terms):
    """Rows where any comma-separated part contains any term, ignoring case."""
    parts = F.transform(F.split(F.lower(F.col(col)), ","), F.trim)
    wanted = F.array(*[F.lit(t.lower()) for t in terms])
    hit = F.exists(parts, lambda part: F.exists(wanted, lambda term: F.contains(part, term)))
    return df.where(F.coalesce(hit, F.lit(False)))


def score_above(peaks, t):
    return peaks.where(F.col("score") > t)


def map_values(df, col, mapping, unmapped="drop"):
    """Replace values by a lookup table (key, val); unmapped rows are dropped or kept."""
    m = mapping.select(F.col("key").alias(col), F.col("val").alias("_new"))
    j = df.join(m, col, "inner" if unmapped == "drop" else "left")
    return j.withColumn(col, F.coalesce("_new", col)).drop("_new")


def encode(df, col, out):
    """0-based code of the sorted distinct label. Only the distinct labels are numbered."""
    codes = df.select(col).distinct().withColumn(out, F.dense_rank().over(W.orderBy(col)) - 1)
    return df.join(codes, col)


def anonymise(df, col, prefix="donor_"):
    """Replace ids by ``donor_{i}`` in sorted order."""
    e = encode(df, col, "_code")
    return e.withColumn(col, F.concat(F.lit(prefix), F.col("_code").cast("string"))).drop("_code")


def parse_id(df, col, pattern, names):
    """Split a structured id into columns by the groups of a pattern."""
    return df.select("*", *[F.regexp_extract(F.col(col), pattern, i + 1).alias(n) for i, n in enumerate(names)])


def parse_peak(df, col="peak"):
    """Coordinates of ``chr:start-end`` or ``chr-start-end``; other contigs are dropped."""
    c, s, e = interval_parts(col)
    return df.select("*", c.alias("chrom"), s.alias("start"), e.alias("end")).where(F.col("chrom").startswith("chr"))


def split_modality(expr, features, kind):
    """Rows of one feature type, by a (gene, feature_type) table."""
    return expr.join(features.where(F.col("feature_type") == kind).select("gene"), "gene", "left_semi")


def drop_dup_genes(genes, name="gene", order=None):
    """All copies of a repeated name go, or all but the first by ``order``."""
    if order is None:
        once = genes.groupBy(name).agg(F.count("*").alias("_n")).where("_n = 1").select(name)
        return genes.join(once, name, "left_semi")
    first = genes.groupBy(name).agg(F.min(order).alias(order))
    return genes.join(first, [name, order], "left_semi")


def format_obs(obs, renames, keep, control=None, control_from=None):
    """Rename and select metadata; flag controls by label."""
    out = obs.withColumnsRenamed(renames)
    if control is not None:
        out = out.withColumn("is_control", F.col(control_from) == control)
    return out.select(*keep)


def group_key(*cols):
    return F.concat_ws("_", *[F.col(c).cast("string") for c in cols])


def ensure_counts(expr):
    """Undo a log1p when any cell total is not a whole number."""
    tot = expr.groupBy("obs_id").agg(F.sum("value").alias("s"))
    logged = tot.select(F.max(F.col("s") != F.floor("s"))).scalar()
    return expr.withColumn("value", F.when(logged, F.expm1("value")).otherwise(F.col("value")))


def clean_values(expr, col="value"):
    """Null, NaN and infinities to zero."""
    v = F.col(col)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return expr.withColumn(col, F.when(bad, 0.0).otherwise(v))


def nonzero_std(expr, obs):
    """Genes that vary over the cells, absent rows being zeros."""
    n = obs.select(F.count("*")).scalar()
    g = (expr.groupBy("gene").agg(F.count("*").alias("nnz"), F.min("value").alias("lo"), F.max("value").alias("hi"))
         .withColumn("lo", F.when(F.col("nnz") < n, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")))
         .withColumn("hi", F.when(F.col("nnz") < n, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi"))))
    return g.where(F.col("hi") > F.col("lo")).select("gene")


def min_targets(edges, n, extra=()):
    """Edges of sources with at least ``n`` edges."""
    by = [*extra, "source"]
    keep = edges.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(*by)
    return edges.join(keep, by, "left_semi")


def load_sets(sets, lo=5, hi=500, name="set_name"):
    """Gene sets (library, set_name, genes) of a size in range, under a cleaned name."""
    genes = F.array_distinct(F.col("genes"))
    clean = F.initcap(F.replace(F.replace(F.col(name), F.lit("HALLMARK_"), F.lit("")), F.lit("_"), F.lit(" ")))
    return (sets.withColumn("genes", genes).withColumn("n_genes", F.size("genes"))
            .where(F.col("n_genes").between(lo, hi)).withColumn(name, clean))


def sets_long(sets):
    return sets.select("library", "set_name", F.explode("genes").alias("gene"))


def universe(edges, tfs, genes, extra=()):
    """Background genes: only factors when every target is one, else all genes."""
    extra = list(extra)
    flagged = genes.join(tfs.select(F.col("tf").alias("gene"), F.lit(True).alias("is_tf")).distinct(), "gene", "left")
    if extra:
        only = (edges.select(*extra, F.col("target").alias("tf")).distinct().join(tfs.select("tf", F.lit(1).alias("_f")).distinct(), "tf", "left")
                .groupBy(*extra).agg((F.count("*") == F.count("_f")).alias("_only")))
        return attach_all(flagged, only).where(~F.col("_only") | F.coalesce("is_tf", F.lit(False))).select(*extra, "gene")
    non_tf = (edges.select(F.col("target").alias("tf")).distinct().join(tfs, "tf", "left_anti"))
    only_tfs = non_tf.select(F.count("*") == 0).scalar()
    return flagged.where(~only_tfs | F.coalesce("is_tf", F.lit(False))).select("gene")


def valid_groups(obs, col, n=200):
    keep = obs.groupBy(col).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(col)
    return obs.join(keep, col, "left_semi")


def fallback_group(obs, cols, out="group"):
    """First candidate column with more than one value, else the first column."""
    several = obs.agg(*[(F.min(c) != F.max(c)).alias(c) for c in cols])
    pick = F.coalesce(*[F.when(F.col(c), F.lit(c)) for c in cols], F.lit(cols[0]))
    chosen = several.select(pick).scalar()
    val = F.coalesce(*[F.when(F.lit(c) == F.col("_pick"), F.col(c)) for c in cols])
    return obs.withColumn("_pick", chosen).withColumn(out, val).drop("_pick")


def sig_filter(edges, p=0.05, score="weight", pcol="p"):
    """Significant edges with a non-zero effect."""
    return edges.where((F.col(pcol) < p) & (F.col(score) != 0))


def apply_prior(edges, skeleton):
    """Edges that the prior skeleton allows."""
    return edges.join(skeleton.select("source", "target"), ["source", "target"], "left_semi")


def canonical_label(df, col, aliases=None):
    """Canonical upper-case label, then an alias table (key, val)."""
    out = df.withColumn(col, canonical(col))
    return out if aliases is None else map_values(out, col, aliases, "keep")


def limit_perturbations(obs, tfs, n):
    """Rows of the first ``n`` factor perturbations in name order."""
    first = (obs.select("perturbation").distinct()
             .join(tfs.select(F.col("tf").alias("perturbation")), "perturbation", "left_semi")
             .orderBy("perturbation").limit(n))
    return obs.join(first, "perturbation", "left_semi")
