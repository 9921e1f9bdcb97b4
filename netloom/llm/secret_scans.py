"""Secret scans: pattern matches and sliding-window entropy, in DataFrame functions only.

Base kinds are patterns (``BASE``). The method adds ``entropy``: candidate strings of one character
class (hex digits; letters alone; letters, digits and base64 marks with a digit among them), each with
a bound of its own, over which a window of ``WINDOW`` characters slides. The window keeps a count per character and the sum of c log2 c; a
step changes the two counts that enter and leave and the sum with them, so a candidate costs one
pass. It is reported if some window's entropy reaches the class's bound, unless the allow-list
pattern fits it. Base spans are cut out of a candidate first; what is left on either side is a
candidate of its own.

Everything is one narrow pass: a guard that is cheap decides whether a text is split at all, spans
come from the lengths of the pieces between matches, and nothing is shuffled. Positions are code
points, ends exclusive.

Edge cases: null or empty text has no spans; spans of different kinds may overlap and are all
reported, equal starts in the order of kinds; repeated rows are scanned one by one; texts of any
length are scanned whole; a column named ``base`` or ``found`` is replaced, all other columns are kept.
"""

import math

from pyspark.sql import Column, DataFrame, functions as F

#: kind -> (pattern, group whose length counts, least length)
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
GUARD = {"assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA[A-Z0-9]{14}", "hex": "[0-9a-f]{16}"}
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?:(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}|[A-Za-z]{20,}(?![A-Za-z0-9+/_=-]))"
ALLOW = r"(?i)example|sample|dummy|placeholder|x{6}|0{8}|12345678|abcdefgh|^[0-9/_=+-]+$|^[A-Za-z]+([-_/=+][A-Za-z]+)*[-_/=+]?[0-9]{1,6}$"
WINDOW, HEX_BITS, LETTER_BITS, MIXED_BITS = 20, 3.0, 3.95, 3.6
KINDS = [*BASE, "entropy"]
MATCHES = "array<struct<s:bigint,e:bigint,t:string>>"


def _xlogx(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def entropy_peak(text: Column, window=WINDOW) -> Column:
    """Largest Shannon entropy (bits) of a window of ``window`` characters; 0 for shorter strings. ASCII."""
    code = F.transform(F.split(text, ""), lambda c: F.ascii(c))

    def step(acc, i):
        into = F.element_at(acc["code"], i)
        out = F.when(i > window, F.element_at(acc["code"], F.greatest(i - window, F.lit(1)))).otherwise(F.lit(-1))
        old = F.when(out >= 0, F.element_at(acc["n"], F.greatest(out, F.lit(0)) + 1)).otherwise(F.lit(0))
        same = F.when(out == into, 1).otherwise(0)
        c = F.element_at(acc["n"], into + 1) - same
        s = acc["s"] - _xlogx(old) + _xlogx(old - 1) - _xlogx(c) + _xlogx(c + 1)
        h = F.when(i >= window, math.log2(window) - s / window).otherwise(F.lit(0.0))
        n = F.transform(acc["n"], lambda v, k: v + F.when(k == into, 1).otherwise(0) - F.when(k == out, 1).otherwise(0))
        return F.struct(acc["code"].alias("code"), n.alias("n"), s.alias("s"), F.greatest(acc["best"], h).alias("best"))

    start = F.struct(code.alias("code"), F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
    return F.when(F.length(text) >= window, F.aggregate(F.sequence(F.lit(1), F.length(text)), start, step, lambda a: a["best"])).otherwise(F.lit(0.0))


def _located(pieces: Column, found: Column, run=128) -> Column:
    """array<struct<s,e,t>> of the matches, from the pieces between them.

    Places are added up in runs of ``run`` matches, so that appending to an array never copies
    more than a run, however many matches a text has.
    """
    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, f: F.struct(p.alias("p"), f.alias("f")))

    def one(acc, x):
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["f"])
        return F.struct(e.cast("bigint").alias("at"), F.concat(acc["out"], F.array(F.struct(s.cast("bigint").alias("s"), e.cast("bigint").alias("e"), x["f"].alias("t")))).alias("out"))

    def many(acc, k):
        inner = F.aggregate(F.slice(acc["pairs"], k * run + 1, run), F.struct(acc["at"].alias("at"), F.array().cast(MATCHES).alias("out")), one)
        bound = F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out"), acc["pairs"].alias("pairs")))
        return F.element_at(bound, 1)

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{MATCHES}>").alias("out"), pairs.alias("pairs"))
    runs = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / run).cast("int"))
    return F.when(F.size(found) > 0, F.aggregate(runs, start, many, lambda a: F.flatten(a["out"])))


def _matches(df: DataFrame, name: str, text: str, pattern: str, guard: Column) -> DataFrame:
    """Adds ``name``: the located matches of ``pattern``, where ``guard`` holds."""
    t, p = F.when(guard, F.col(text)), F.lit(pattern)
    df = df.withColumn(f"{name}_p", F.split(t, pattern, -1)).withColumn(f"{name}_f", F.regexp_extract_all(t, p, 0))
    return df.withColumn(name, F.coalesce(_located(F.col(f"{name}_p"), F.col(f"{name}_f")), F.array().cast(MATCHES))).drop(f"{name}_p", f"{name}_f")


def _at_least(pattern: str, group: int, least: int):
    return lambda m: F.length(F.regexp_extract(m["t"], pattern, group)) >= least


def _remains(m: Column, base: Column) -> Column:
    """The parts of a match that no base span covers, as array<struct<s,e,t>>."""
    inside = F.filter(base, lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"]))
    part = lambda s, e: F.struct(s.cast("bigint").alias("s"), e.cast("bigint").alias("e"),
                                 F.substring(m["t"], (s - m["s"]).cast("int") + 1, (e - s).cast("int")).alias("t"))

    def step(acc, b):
        more = F.when(b["s"] > acc["at"], F.array(part(acc["at"], b["s"]))).otherwise(F.array().cast(MATCHES))
        return F.struct(F.greatest(acc["at"], b["e"]).alias("at"), F.concat(acc["out"], more).alias("out"))

    start = F.struct(m["s"].cast("bigint").alias("at"), F.array().cast(MATCHES).alias("out"))
    rest = F.aggregate(inside, start, step, lambda acc: F.concat(acc["out"], F.when(acc["at"] < m["e"], F.array(part(acc["at"], m["e"]))).otherwise(F.array().cast(MATCHES))))
    return F.when(F.size(inside) == 0, F.array(part(m["s"], m["e"]))).otherwise(rest)


def scan(docs: DataFrame, text_col="text", window=WINDOW, hex_bits=HEX_BITS, letter_bits=LETTER_BITS, mixed_bits=MIXED_BITS, allow=ALLOW) -> DataFrame:
    """``docs`` with ``base`` and ``found``: arrays of (s start, k kind number, e end), sorted by start and kind."""
    df, x = docs.drop("base", "found"), "_scan"
    while any(c.startswith(x) for c in df.columns):  # own helper columns never meet the caller's
        x = "_" + x
    kept, df = df.columns, df.withColumn(x, F.coalesce(F.col(text_col), F.lit("")))
    for kind, (pattern, group, least) in BASE.items():
        guard = F.col(x).rlike(GUARD[kind])
        # a maximal run of hex digits is short or a match: asking for the length keeps words out of the arrays
        df = _matches(df, f"{x}_{kind}", x, f"[0-9a-f]{{{least},}}" if kind == "hex" else pattern, guard)
        df = df.withColumn(f"{x}_{kind}", F.filter(f"{x}_{kind}", _at_least(pattern, group, least)))
    cand = f"{x}_cand"
    df = _matches(df, cand, x, CANDIDATE, F.col(x).rlike(CANDIDATE))
    span = lambda i: (lambda m: F.struct(m["s"].alias("s"), F.lit(i).alias("k"), m["e"].alias("e")))
    df = df.withColumn("base", F.array_sort(F.concat(*[F.transform(f"{x}_{k}", span(i)) for i, k in enumerate(BASE)])))
    df = df.withColumn(cand, F.flatten(F.transform(cand, lambda m: _remains(m, F.col("base")))))
    bound = lambda m: (F.when(m["t"].rlike("^[0-9A-Fa-f]+$"), hex_bits).when(m["t"].rlike("^[A-Za-z]+$"), letter_bits)
                       .when(m["t"].rlike("[0-9]"), mixed_bits))
    df = df.withColumn(cand, F.filter(cand, lambda m: (F.length(m["t"]) >= window) & ~m["t"].rlike(allow)))
    df = df.withColumn(cand, F.filter(cand, lambda m: F.coalesce(entropy_peak(m["t"], window) >= bound(m), F.lit(False))))
    return df.withColumn("found", F.array_sort(F.concat("base", F.transform(cand, span(len(BASE)))))).select(*kept, "base", "found")


def written(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.element_at(kinds, m["k"] + 1), m["s"].cast("string"), m["e"].cast("string"))), ",")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda m: m["k"] == KINDS.index(kind))).cast("bigint")


def redact(docs: DataFrame, text_col="text", mark="[SECRET]") -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mark``; overlapping spans become one."""
    df = scan(docs, text_col).drop("base")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, m):
        fresh = m["s"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(F.col(text_col), acc["at"].cast("int") + 1, F.greatest(m["s"] - acc["at"], F.lit(0)).cast("int")), F.lit(mark))
        return F.struct(F.greatest(acc["at"], m["e"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    text = F.aggregate("found", start, step, lambda a: F.concat(a["out"], F.substring(F.col(text_col), a["at"].cast("int") + 1, F.length(text_col))))
    return df.withColumn(text_col, F.when(F.size("found") > 0, text).otherwise(F.col(text_col))).drop("found")
