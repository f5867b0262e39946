"""URL filter: rules first, then boosted trees on lexical features.

A rule names a host and the start of a path; it fits the host and all its
subdomains, and the longest fitting rule decides.  URLs that a rule decides are
the labelled ones: from a bounded sample of the different ones, by hash, filled up for
a label that is rare in it, trees are boosted that judge the rest.  Features are SQL expressions: length, depth, digit ratio, entropy
of the characters, parameter counts, and the smoothed block rate of the host's
last two labels among the sample.

Defined results: a null url, or one without `://`, has an empty host and path and
no rule; rules of equal length are tried block first, then in order of their text;
where the sample has one label only, or none, the rest gets that label (allow if
none); repeated rows and null ids are judged like others; an empty table gives no
rows.  Other columns are not used.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
SAMPLE = 4000
RARE = 20  # a label gets 1 / RARE of the sample, if it has as many URLs
FEATURES = "length depth digits entropy parameters fragments host_length labels hyphens path_digits suffix_rate".split()


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.when(F.col(url).contains("://"), F.expr(f"substr({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null.

    Rules are configuration, looked up as a chain of conditions, longest first.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def _suffix(host: str = "host") -> Column:
    return F.substring_index(host, ".", -2)


def _share(pattern: str, text: Column) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def lexical(rows: DataFrame) -> DataFrame:
    """Add the features that need the url alone; the columns url, host and path are read."""
    url = F.coalesce(F.col("url"), F.lit(""))
    letters = F.split(F.lower(url), "")
    distinct = F.array_distinct(letters)
    # The characters of a url are few; each is counted by what its removal takes away.
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    share = lambda c: (F.length(url) - F.length(F.replace(F.lower(url), c, F.lit("")))) / n
    entropy = F.aggregate(
        F.filter(distinct, lambda c: c != ""),
        F.lit(0.0),
        lambda a, c: a - share(c) * F.log2(F.greatest(share(c), F.lit(1e-9))),
    )
    return rows.withColumns(
        {
            "length": n,
            "depth": F.regexp_count("path", F.lit("/[^/]+")).cast("double"),
            "digits": _share("[0-9]", url),
            "entropy": entropy,
            "parameters": F.regexp_count(url, F.lit("[?&][^=&#]+=")).cast("double"),
            "fragments": F.regexp_count(url, F.lit("#")).cast("double"),
            "host_length": F.length("host").cast("double"),
            "labels": F.regexp_count("host", F.lit("[^.]+")).cast("double"),
            "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "path_digits": F.regexp_count("path", F.lit("[0-9]")).cast("double"),
        }
    )


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE, trees: int = 8, seed: int = 11) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``."""
    host, path = parts()
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, "ruled": verdict})
    spark = pages.sparkSession
    # Copies of a url count once, or they could fill the sample.
    marked = rows.where(F.col("ruled").isNotNull()).select("url", "host", "path", "ruled").distinct()

    def first(found: DataFrame, n: int) -> list:
        return found.orderBy(F.xxhash64("url", F.lit(seed)), "url").limit(n).collect()

    taken = first(marked, sample)
    if len(taken) == sample:
        for kind in sorted({r[0] for r in rules}):
            if sum(r["ruled"] == kind for r in taken) < sample // RARE:
                known = {r["url"] for r in taken}
                taken += [r for r in first(marked.where(F.col("ruled") == kind), sample // RARE) if r["url"] not in known]
    seen = sorted({r["ruled"] for r in taken})
    if len(seen) < 2:
        rest = F.lit(seen[0] if seen else "allow")
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", rest).alias("verdict"))
    # At most ``sample`` suffixes come from the sample, so their rates fit in every task.
    sampled = spark.createDataFrame(taken, "url string, host string, path string, ruled string").coalesce(1)
    blocked = F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)
    prior = sum(r["ruled"] == "block" for r in taken) / len(taken)
    rates = (
        sampled.groupBy(_suffix().alias("suffix"))
        .agg(((F.sum(blocked) + 5 * prior) / (F.count("*") + 5)).alias("suffix_rate"))
        .collect()
    )
    rates = F.broadcast(spark.createDataFrame(rates, "suffix string, suffix_rate double"))

    def featured(df: DataFrame) -> DataFrame:
        df = lexical(df).withColumn("suffix", _suffix()).join(rates, "suffix", "left")
        df = df.withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(prior)))
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)

    learner = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=3, maxBins=32, stepSize=0.3, seed=seed)
    model = learner.fit(featured(sampled).withColumn("label", blocked).select("features", "label"))
    judged = model.transform(featured(rows))
    learned = F.when(vector_to_array("probability")[1] >= 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"))
