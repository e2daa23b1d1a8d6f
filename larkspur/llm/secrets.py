"""Secret scans: fixed patterns, and a battery of randomness tests for what no pattern names.

Candidates are long runs of code-like characters. The encoding is inferred from the characters (hexadecimal, base 32,
letters and digits, base 64) and gives every character a value. Three statistics compare a candidate with text: the
chi-squared distance from a uniform alphabet, the number of runs, and the lag-1 serial correlation. The null hypothesis
of each test is the text-like one (a chi-squared excess per character, a share of changes, or a correlation of at least a
fixed size). Where an alphabet has several classes of characters (capitals, small letters, digits), runs are those of a
class, since names seldom change class and keys do so all the time; the evidence of this and of chi-squared, which looks at
frequencies and not at order, is added by Stouffer's method, and a candidate correlated like a sequence is none. Letters of
one case have one class: they must pass all three tests with runs about the alphabet's middle, and short ones cannot reach
a small p-value. Benjamini-Hochberg control runs over all candidates of the corpus
within bands of length, from counts of p-values in fixed bins; no candidate list is ever gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import written

# The patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the runs AKIA[A-Z0-9]+ of 20 and more characters
HEX = r"[0-9a-f]{24,}"  # the runs [0-9a-f]+ of 24 and more characters
KINDS = ("assign", "access", "hex", "random")

#: Matches of a text whose places are added up together.
CHUNK = 128

#: What the battery looks at: runs of at least 20 code-like characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

# Alphabet sizes, and the chi-squared excess per character that text has in each: the chance that two of its
# characters are equal (0.06, more in hexadecimal) times the size, less 1.
ALPHABETS = {"hex": (16, 1.0), "base32": (32, 0.92), "letters": (26, 0.56), "base36": (36, 1.16), "base64": (64, 2.84)}

#: The other effects that the tests must reject: lost share of runs, correlation.
RUNS_LOST, CORRELATION = 0.5, 0.6

#: Share of neighbours of different classes that names have at most; separators are no class and no neighbours.
CHANGES = {"hex": 0.15, "base32": 0.15, "letters": 0.0, "base36": 0.15, "base64": 0.3}

#: Bands of length, each with its own false-discovery control, and bins of -log10 p.
BANDS, BINS, BIN_WIDTH = (20, 24, 32, 48, 64, 128, 256), 400, 0.05


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def spans(text: Column, pattern: str, kind: str, keep: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of pattern as structs (start, end, kind), in code points.

    split() cuts at the very matches that regexp_extract_all() returns, so lengths of pieces and matches add up to
    positions; they are added up in chunks of CHUNK matches, and over chunks, so that no long array is copied for each match.
    keep: a boolean array, one for each match; the others are dropped.
    """
    pieces, hits = F.split(text, pattern, -1), found(text, pattern)
    empty = F.array().cast("array<struct<start:int,end:int>>")
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda a, b: F.struct(F.char_length(a).alias("gap"), F.char_length(b).alias("size")))

    def chunked(pairs: Column) -> Column:
        """Chunks, each with the text's length before it."""
        chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(pairs) / CHUNK).cast("int") - 1), lambda i: F.slice(pairs, i * CHUNK + 1, F.lit(CHUNK)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,pairs:array<struct<gap:int,size:int>>>>").alias("out"))

        def step(acc: Column, c: Column) -> Column:
            length = F.aggregate(c, F.lit(0), lambda n, x: n + x["gap"] + x["size"])
            return F.struct((acc["at"] + length).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), c.alias("pairs")))).alias("out"))

        return F.aggregate(chunks, start, step, lambda acc: acc["out"])

    def placed(chunk: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["gap"]
            one = F.struct(begin.alias("start"), (begin + x["size"]).alias("end"))
            return F.struct((begin + x["size"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(chunk["pairs"], F.struct(chunk["at"].alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    out = F.flatten(F.transform(chunked(pairs), placed))
    if keep is not None:
        out = F.transform(F.filter(F.arrays_zip(out.alias("s"), keep.alias("k")), lambda x: x["k"]), lambda x: x["s"])
    out = F.transform(out, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind")))
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast("array<struct<start:int,end:int,kind:int>>"))


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds, by start, then kind."""
    long_enough = F.transform(found(text, ASSIGN, 2), lambda g: F.char_length(g) >= 6)
    return F.array_sort(F.concat(spans(text, ASSIGN, "assign", long_enough), spans(text, ACCESS, "access"), spans(text, HEX, "hex")), by_start)


def by_start(a: Column, b: Column) -> Column:
    def key(s: Column) -> Column:
        return s["start"].cast("long") * 8 + s["kind"]

    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def joined(found_spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found_spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def normal_below(z: Column) -> Column:
    """P(Z <= z) of a standard normal by the logistic approximation of Bowling and others (error below 0.00014)."""
    z = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(0.07056) * z * z * z + F.lit(1.5976) * z)))


def safely_below(z: Column) -> Column:
    """P(Z <= z) of a standard normal, never too small in the lower tail, where Mills' ratio bounds it."""
    far = F.greatest(F.least(z, F.lit(-2.0)), F.lit(-35.0))
    return F.when(z < -2, F.exp(-far * far / 2) / (-far * math.sqrt(2 * math.pi))).otherwise(normal_below(z))


def battery(tokens: DataFrame) -> DataFrame:
    """tokens with a string column token: adds encoding, k (alphabet size), n and p, combined from the tests.

    A token with a repeated-character or one-letter alphabet has no variance; its p is 1.
    """
    t = F.col("token")
    encoding = F.when(t.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(t.rlike("^[A-Z2-7]+=*$"), "base32").when(t.rlike("^([a-z]+|[A-Z]+)$"), "letters").when(t.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), "base36").otherwise("base64")
    rows = tokens.withColumn("encoding", encoding)
    sizes, excesses = (F.create_map(*[F.lit(x) for name, v in ALPHABETS.items() for x in (name, v[i])]) for i in range(2))
    rows = rows.withColumn("k", sizes[F.col("encoding")])
    folded = F.when(F.col("encoding").isin("hex", "letters", "base36"), F.lower(t)).otherwise(F.regexp_replace(t, "=+$", ""))
    order = F.when(F.col("encoding") == "base32", F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")).when(F.col("encoding") == "letters", F.lit("abcdefghijklmnopqrstuvwxyz")).when(F.col("encoding") == "base64", F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")).otherwise(F.lit("0123456789abcdefghijklmnopqrstuvwxyz"))
    rows = rows.withColumn("folded", F.translate(folded, "-_=", "+//")).withColumn("order", order)
    rows = rows.withColumn("v", F.transform(F.split("folded", ""), lambda c: (F.instr(F.col("order"), c) - 1).cast("double")))
    rows = rows.withColumn("n", F.size("v").cast("double")).where("n >= 2")
    zero = F.lit(0.0)
    counts = F.transform(F.array_distinct("v"), lambda x: F.size(F.filter(F.col("v"), lambda y: y == x)).cast("double"))
    rows = rows.withColumn("squares", F.aggregate(counts, zero, lambda a, c: a + c * c))
    rows = rows.withColumn("mean", F.aggregate("v", zero, lambda a, x: a + x) / F.col("n"))
    shifted = F.zip_with(F.slice("v", 1, F.size("v") - 1), F.slice("v", 2, F.size("v") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = rows.withColumn("pairs", shifted)
    rows = rows.withColumn("variance", F.aggregate("v", zero, lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))))
    rows = rows.withColumn("covariance", F.aggregate("pairs", zero, lambda a, p: a + (p["a"] - F.col("mean")) * (p["b"] - F.col("mean"))))
    # neighbours that are both letters or digits, and whether their classes differ
    classes = F.transform(F.split(t, ""), lambda c: F.when(c.rlike("[0-9]"), 0).when(c.rlike("[A-Z]"), 1).when(c.rlike("[a-z]"), 2))
    rows = rows.withColumn("classes", classes)
    rows = rows.withColumn("classes", F.filter(F.zip_with(F.slice("classes", 1, F.size("classes") - 1), F.slice("classes", 2, F.size("classes") - 1), lambda a, b: a != b), lambda x: x.isNotNull()))
    rows = rows.withColumn("class_pairs", F.size("classes").cast("double")).withColumn("class_changes", F.size(F.filter("classes", lambda x: x)).cast("double"))
    half = F.col("k") / 2.0
    rows = rows.withColumn("changes", F.aggregate("pairs", zero, lambda a, p: a + F.when((p["a"] < half) != (p["b"] < half), 1.0).otherwise(0.0)))
    n, k = F.col("n"), F.col("k").cast("double")
    chi = k * F.col("squares") / n - n
    excess = n * excesses[F.col("encoding")]
    z_chi = (chi - (k - 1 + excess)) / F.sqrt(2 * (k - 1 + 2 * excess))
    p_chi = safely_below(z_chi)
    lost = (n - 1) / 2 * (1 - F.lit(RUNS_LOST))
    p_runs = 1 - normal_below((F.col("changes") - lost) / F.sqrt((n - 1) / 4))
    r = F.when(F.col("variance") > 0, F.col("covariance") / F.col("variance")).otherwise(1.0)
    p_serial = normal_below((F.abs(r) - CORRELATION) * F.sqrt(n))
    usual = F.create_map(*[F.lit(x) for name, v in CHANGES.items() for x in (name, v)])[F.col("encoding")]
    m = F.col("class_pairs")
    # the arcsine makes the variance of a share the same everywhere
    z_class = F.when(m > 0, 2 * F.sqrt(m) * (F.asin(F.sqrt(usual)) - F.asin(F.sqrt(F.col("class_changes") / m)))).otherwise(0.0)
    p_mixed = F.when(F.abs(r) < CORRELATION, safely_below((z_chi + z_class) / math.sqrt(2))).otherwise(1.0)
    p = F.when(F.col("encoding") == "letters", F.greatest(p_chi, p_runs, p_serial)).otherwise(p_mixed)
    p = F.when(F.col("variance") > 0, p).otherwise(1.0)
    return rows.withColumn("p", F.least(p, F.lit(1.0))).drop("folded", "order", "v", "squares", "mean", "pairs", "variance", "covariance", "changes", "classes", "class_pairs", "class_changes")


def banded(tokens: DataFrame) -> DataFrame:
    band = F.lit(0)
    for i, least in enumerate(BANDS):
        band = F.when(F.col("n") >= least, i).otherwise(band)
    bin_ = F.least(F.lit(BINS - 1), F.floor(-F.log10(F.greatest(F.col("p"), F.lit(1e-300))) / BIN_WIDTH)).cast("int")
    return tokens.withColumn("band", band).withColumn("bin", bin_)


def discoveries(counts: DataFrame, q: float) -> DataFrame:
    """(band, least_bin): Benjamini-Hochberg within each band, from (band, bin, count); at most BANDS x BINS rows.

    A bin's upper p-value stands for all its members, so the control is on the safe side. A band with m candidates of
    which c have a p-value up to t keeps them if t * m <= q * c.
    """
    upto = W.partitionBy("band").orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy("band")
    rows = counts.withColumn("c", F.sum("count").over(upto)).withColumn("m", F.sum("count").over(every))
    rows = rows.where(F.pow(F.lit(10.0), -F.col("bin") * BIN_WIDTH) * F.col("m") <= q * F.col("c"))
    return rows.groupBy("band").agg(F.min("bin").alias("least_bin"))


def secret_scan(docs: DataFrame, q: float = 0.05) -> DataFrame:
    """One row per row of docs: doc_id, base and spans, both arrays of (start, end, kind) by start, then kind.

    base holds the fixed kinds, spans those and the runs that the battery declares random at false-discovery rate q and
    that overlap no base span. Offsets are code points, end exclusive; kind indexes KINDS. A null text counts as empty;
    other columns and clashing names are ignored; rows that repeat a doc_id are scanned one by one; an empty table gives an
    empty result. Whole texts of any length are scanned in one pass; only counts of p-values by length band move, and their thresholds (one row for each of the
    fixed bands) come back by broadcast.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", base_spans(text).alias("base"), F.when(text.rlike(CANDIDATE), F.arrays_zip(spans(text, CANDIDATE, "random").alias("s"), found(text, CANDIDATE).alias("token"))).alias("c"))
    clear = F.filter("c", lambda x: ~F.exists("base", lambda b: (b["start"] < x["s"]["end"]) & (x["s"]["start"] < b["end"])))
    rows = written(rows.withColumn("c", clear).withColumn("row", F.monotonically_increasing_id()), "secrets")
    tokens = rows.where(F.size("c") > 0).select("row", F.explode("c").alias("c")).select("row", "c.s", "c.token")
    scored = banded(battery(tokens))
    limits = discoveries(scored.groupBy("band", "bin").count(), q)
    hits = scored.join(F.broadcast(limits), "band").where("bin >= least_bin").groupBy("row").agg(F.collect_list("s").alias("hits"))
    rows = rows.join(hits, "row", "left")
    extra = F.coalesce("hits", F.array().cast("array<struct<start:int,end:int,kind:int>>"))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", extra), by_start).alias("spans"))
