"""Text formats: GMT, GTF, BED dialects, lists, traces, regulons, region sets."""

from pyspark.sql import DataFrame, functions as F

from netloom import schemas
from netloom.operators.filters import parse_peak


def read_gmt(spark, path, library=None) -> DataFrame:
    """``name <tab> description <tab> gene ...`` per line."""
    p = F.split(F.rtrim("value"), "\t")
    lib = F.lit(library) if library else F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)\.gmt", 1)
    return spark.read.text(path).select(lib.alias("library"), F.get(p, 0).alias("set_name"), F.get(p, 1).alias("description"),
                                        F.slice(p, F.lit(3), F.size(p)).alias("genes")).where("set_name != ''")


def write_gmt(sets, path):
    line = F.concat_ws("\t", "set_name", F.coalesce("description", F.lit("")), F.concat_ws("\t", "genes"))
    sets.select(line.alias("value")).write.mode("overwrite").text(path)


def read_gtf(spark, path) -> DataFrame:
    """Gene rows with their name (or id) and strand-aware start site."""
    g = spark.read.csv(path, sep="\t", comment="#", schema=schemas.GTF, quote="").where("feature = 'gene'")
    name = F.regexp_extract("attributes", r'gene_name "([^"]+)"', 1)
    gene = F.when(name != "", name).otherwise(F.regexp_extract("attributes", r'gene_id "([^"]+)"', 1))
    return g.select("chrom", "start", "end", "strand", gene.alias("gene"), F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end")).alias("tss"))


def add_interval(genes, gtf):
    """``chr:start-end`` of each gene; the last record of a name wins."""
    loc = gtf.where("gene != ''").groupBy("gene").agg(F.max(F.struct("chrom", "start", "end")).alias("l"))
    iv = F.concat(F.col("l.chrom"), F.lit(":"), F.col("l.start").cast("string"), F.lit("-"), F.col("l.end").cast("string"))
    return genes.join(loc.select("gene", iv.alias("interval")), "gene", "left")


def read_peaks(spark, path, dialect) -> DataFrame:
    """Nine-column peak files whose fourth column names the factor: ``Name=TF%...`` with encoded
    blanks, or ``experiment.tf.cell``."""
    cols = "chrom string, start bigint, stop bigint, metadata string, score string, strand string, thick_start string, thick_end string, rgb string"
    p = spark.read.csv(path, sep="\t", comment="#", schema=cols)
    if dialect == "encoded":
        p = p.withColumn("tf", F.replace(F.trim(F.nullif(F.regexp_extract("metadata", r"Name=([^%]+)%", 1), F.lit(""))), F.lit("%20"), F.lit(" ")))
    elif dialect == "dotted":
        s = F.split("metadata", r"\.", 3)
        p = p.withColumn("experiment", F.get(s, 0)).withColumn("tf", F.get(s, 1)).withColumn("cell_type", F.get(s, 2))
    else:
        raise ValueError(f"unknown peak dialect {dialect}")
    return p.withColumn("score", F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)))


BED_SOURCES = ("unibind", "chipatlas", "remap2022")  # fixed values: four-column binding sources


def read_tfb(spark, path, source) -> DataFrame:
    """Binding files of at least four columns: contig, start, end, factor."""
    if source not in BED_SOURCES:
        raise ValueError(f"unknown source {source}")
    raw = spark.read.csv(path, sep="\t", comment="#")
    if len(raw.columns) < 4:
        raise ValueError(f"expected at least 4 columns for {source}, got {len(raw.columns)}")
    c = raw.columns
    return raw.select(F.col(c[0]).alias("chrom"), F.col(c[1]).try_cast("bigint").alias("start"), F.col(c[2]).try_cast("bigint").alias("stop"),
                      F.col(c[3]).alias("tf"), F.lit(1.0).alias("score"))


def read_tss(spark, path, layout="bed") -> DataFrame:
    """Start sites from a BED-like file or the refGene layout."""
    raw = spark.read.csv(path, sep="\t", comment="#")
    at = {"bed": (0, 5, 1, 2, 3), "refgene": (2, 3, 4, 5, 12)}[layout]
    chrom, strand, lo, hi, gene = (F.col(raw.columns[i]) for i in at)
    lo, hi = F.coalesce(lo.try_cast("bigint"), F.lit(0)), F.coalesce(hi.try_cast("bigint"), F.lit(0))
    return raw.select(chrom.alias("chrom"), strand.alias("strand"), F.when(strand == "+", lo).otherwise(hi).alias("tss"), gene.alias("gene"))


def read_tf_list(spark, path, header=False) -> DataFrame:
    """One factor per line."""
    t = spark.read.csv(path, header=header, schema="tf string").select(F.trim("tf").alias("tf"))
    return t.where("tf != ''").distinct()


def read_ground_truth(spark, paths) -> DataFrame:
    """Ground-truth edges of several sources (name -> CSV path); unreadable and empty files are
    skipped, a file without source and target columns is an error."""
    out = None
    for name, path in paths.items():
        try:
            df = spark.read.csv(path, header=True)
            empty = df.isEmpty()
        except Exception as e:  # noqa: BLE001 - a missing or broken file only drops its source
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                continue
            raise
        if empty:
            continue
        schemas.require(df, ["source", "target"], f"ground truth {name}")
        part = df.select(F.lit(name).alias("gt"), "source", "target")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no readable ground truth")
    return out


def read_trace(spark, path) -> DataFrame:
    """Task traces with a header per file; short lines are dropped. The run date comes from
    ``trace_YYYY-MM-DD.txt`` in the path, else from the file time."""
    t = spark.read.option("columnPruning", "false").csv(path, sep="\t", header=True, mode="DROPMALFORMED")
    f = F.url_decode(F.col("_metadata.file_path"))
    day = F.regexp_extract(f, r"trace_(\d{4}-\d{2}-\d{2})\.txt", 1)
    date = F.coalesce(day.try_cast("date"), F.to_date(F.col("_metadata.file_modification_time")))
    return t.select("*", F.regexp_extract(f, r"(trace[^/=]*\.txt)", 1).alias("source_file"), date.alias("file_date"))


def to_fragments(access, obs) -> DataFrame:
    """Sparse chromatin matrix as fragments (chrom, start, end, barcode, count) per donor, in
    genomic order."""
    f = parse_peak(access.join(obs.select("obs_id", "donor_id"), "obs_id")).select(
        F.replace("donor_id", F.lit(" "), F.lit("_")).alias("donor_id"), "chrom", "start", "end",
        F.replace("obs_id", F.lit("-"), F.lit("")).alias("barcode"), F.col("value").cast("bigint").alias("count"))
    return f.repartitionByRange("donor_id", "chrom", "start").sortWithinPartitions("donor_id", "chrom", "start", "end", "barcode")


def write_regions(regions, path, group):
    """Sorted BED files, one directory per group. A range partitioning spreads a large group over
    several sorted files."""
    (regions.select(group, "chrom", "start", "stop").repartitionByRange(group, "chrom", "start", "stop")
     .sortWithinPartitions(group, "chrom", "start", "stop").write.mode("overwrite").partitionBy(group).csv(path, sep="\t"))


def parse_regulons(df, col="targets") -> DataFrame:
    """``[('GENE', 1.5), ...]`` texts to one row per pair."""
    pat = r"""\(\s*['"]([^'"]+)['"]\s*,\s*([-+0-9.eE]+)\s*\)"""
    z = F.arrays_zip(F.regexp_extract_all(col, F.lit(pat), 1).alias("g"), F.regexp_extract_all(col, F.lit(pat), 2).alias("w"))
    return df.select("source", F.explode(z).alias("z")).select("source", F.col("z.g").alias("target"), F.col("z.w").try_cast("double").alias("weight"))
